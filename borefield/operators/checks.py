"""The tables' constraints as a job that lists violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import GRID_SRID
from .levels import BASES, KNOWN, MISSING
from .trends import CLASSES


Rule = tuple[str, Column, Column]


def _rows(df: DataFrame, key: str, *rules: Rule) -> DataFrame:
    """(rule, key, detail) of each row and rule that is false there; unknown passes, as in SQL. One pass for all rules."""
    broken = F.array(*(F.when(~F.coalesce(holds, F.lit(True)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, holds, detail in rules))
    found = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("x"))
    return found.select("x.rule", "key", "x.detail")


def _null(df: DataFrame, table: str, *columns: str) -> list[Rule]:
    """A rule for each of `columns` that the table has."""
    return [(f"{table}.{c}.not_null", F.col(c).isNotNull(), F.lit("null")) for c in columns if c in df.columns]


def _srid(df: DataFrame, table: str) -> list[Rule]:
    """The grid's code, on rows that have one; a null is the not-null rule's."""
    return [(f"{table}.srid", F.col("srid") == GRID_SRID, F.col("srid"))] if "srid" in df.columns else []


def _twice(df: DataFrame, rule: str, *key: str) -> DataFrame:
    twice = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("key"), F.col("n").cast("string").alias("detail"))


def _orphans(df: DataFrame, rule: str, parents: DataFrame) -> DataFrame:
    """A missing parent once for each child key, with the number of rows; rows of one key are summed before the shuffle."""
    lost = df.where("bore_id IS NOT NULL").groupBy("bore_id").agg(F.count("*").alias("n")).join(parents.select("bore_id"), "bore_id", "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col("bore_id").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


#: Columns that may not be null, beside the keys. Tables in the making need not have all of them yet.
PROVENANCE = ("source_file", "source_crs", "loaded_at")
COUNTED = ("n_observations", "n_months_present", "span_years", "distinct_years", "gap_fraction", "longest_gap_months", "deseasonalised", "computed_at")


def check_bores(bores: DataFrame) -> DataFrame:
    """A point, its code, the datum flag and where the row is from are there, the flag is known and agrees with the collar, and keys are unique."""
    status, collar = F.col("datum_status"), F.col("collar_rl_m_ahd")
    agrees = ((status == KNOWN) & collar.isNotNull()) | ((status == MISSING) & collar.isNull())
    rules = [
        *_null(bores, "bore", "bore_id", "x", "y", "srid", "datum_status", *PROVENANCE),
        ("bore.datum_status", status.isin(KNOWN, MISSING), status),
        ("bore.datum_status_agrees", agrees, status),
        *_srid(bores, "bore"),
    ]
    return _twice(bores, "bore.primary_key", "bore_id").unionByName(_rows(bores, "bore_id", *rules))


def check_readings(readings: DataFrame, bores: DataFrame) -> DataFrame:
    """Row rules, one reading a bore and time, and a bore for each reading: one scan of the readings and one exchange.

    Every reading gives its own key, its bore's key and the rules it breaks; bores give theirs. All are counted by key, in
    part before the exchange, so a bore with a third of the readings is one row a task.
    """
    something = F.col("depth_to_water_m").isNotNull() | F.col("level_m_ahd").isNotNull()
    rules = [
        *_null(readings, "water_level", "bore_id", "observed_at", "source_file", "loaded_at"),
        ("water_level.depth_or_level", something, F.col("observed_at")),
    ]
    unique, parent = "water_level.unique", "water_level.foreign_key"
    bore, time = F.col("bore_id").cast("string"), F.col("observed_at").cast("string")

    def entry(rule: str, key: Column, detail: Column, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(rule).alias("rule"), key.alias("key"), detail.cast("string").alias("detail")))

    has_bore = F.col("bore_id").isNotNull()
    keys = [entry(unique, bore, time, has_bore & F.col("observed_at").isNotNull()), entry(parent, bore, F.lit(None), has_bore)]
    broken = [entry(rule, bore, detail, ~F.coalesce(holds, F.lit(True))) for rule, holds, detail in rules]
    told = readings.select(F.explode(F.array_compact(F.array(*keys, *broken))).alias("e")).select("e.*", F.lit(False).alias("known"))
    known = bores.where("bore_id IS NOT NULL").select(F.lit(parent).alias("rule"), F.col("bore_id").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"), F.lit(True).alias("known"))
    counted = told.unionByName(known).groupBy("rule", "key", "detail").agg(F.count(F.when(~F.col("known"), 1)).alias("n"), F.max("known").alias("known"))
    kept = counted.where(F.when(F.col("rule") == unique, F.col("n") > 1).when(F.col("rule") == parent, ~F.col("known")).otherwise(True))
    is_key, n = F.col("rule").isin(unique, parent), F.col("n").cast("string")
    key = F.when(F.col("rule") == unique, F.concat_ws("|", "key", "detail")).otherwise(F.col("key"))
    times = F.when(is_key, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "n"))  # a row for each reading that breaks a rule of rows
    return kept.select("rule", key.alias("key"), F.when(is_key, n).otherwise(F.col("detail")).alias("detail"), F.explode(times)).drop("col")


def check_trends(trends: DataFrame, bores: DataFrame) -> DataFrame:
    kind, reason, p, slope = (F.col(c) for c in ("trend_class", "insufficient_reason", "p_value", "sens_slope_m_per_year"))
    none = kind == CLASSES[3]
    whole = (none & reason.isNotNull() & p.isNull() & slope.isNull()) | (~none & reason.isNull() & p.isNotNull())
    rules = [
        *_null(trends, "bore_trend", "bore_id", "basis", "trend_class", *COUNTED),
        ("bore_trend.trend_class", kind.isin(*CLASSES), kind),
        ("bore_trend.basis", F.col("basis").isin(*BASES), F.col("basis")),
        ("bore_trend.statistics", whole, kind),
    ]
    found = [_twice(trends, "bore_trend.primary_key", "bore_id"), _rows(trends, "bore_id", *rules), _orphans(trends, "bore_trend.foreign_key", bores)]
    return reduce(DataFrame.unionByName, found)


def check_areas(areas: DataFrame, table: str, key: str, geometry: bool) -> DataFrame:
    """Districts (`geometry`: a shape is demanded) and licences: unique keys, the grid's code on each shape, where rows are from."""
    needed = ("name", "geom") if geometry else ()
    on_grid = F.col("geom").isNull() | F.coalesce(F.col("srid") == GRID_SRID, F.lit(False))
    rules = [*_null(areas, table, key, *needed, *PROVENANCE), (f"{table}.srid", on_grid, F.coalesce(F.col("srid").cast("string"), F.lit("null")))]
    return _twice(areas, f"{table}.primary_key", key).unionByName(_rows(areas, key, *rules))


def check_districts(areas: DataFrame) -> DataFrame:
    return check_areas(areas, "wcd_boundary", "wcd_id", geometry=True)


def check_licences(areas: DataFrame) -> DataFrame:
    return check_areas(areas, "licence", "licence_id", geometry=False)
