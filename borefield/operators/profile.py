"""What the columns of tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_order
from ..staging import stage
from .scan import null_safe
from .selection import exact_medians

# Distinct values up to which they are listed, and how many are shown of more.
MAX_CODES, SAMPLES = 12, 3

_SCHEMA = (
    "column string, kind string, n_rows long, n_null long, least double, median double, greatest double, "
    "first string, last string, n_distinct long, date_order string, codes string, samples string"
)
_TYPES = {c.split()[0]: c.split()[1] for c in _SCHEMA.split(", ")}


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType | T.BooleanType):
        return "number"
    return "time" if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else "text"


def text_profile(counts: DataFrame, keys: list[str], max_codes: int = MAX_CODES) -> DataFrame:
    """(keys, n_distinct, date_order, codes, samples) of text values that were counted: `counts` (keys, v, k).

    Sorted values, joined by |, when there are `max_codes` or fewer, else the SAMPLES least. Only the first values of a key are ranked
    and gathered; the rest is summed where it lies.
    """
    known = counts.where("v IS NOT NULL")
    whole = known.groupBy(*keys).agg(F.count("*").alias("n_distinct"), date_order(F.col("v"), F.col("k")).alias("date_order"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    few = known.select(*keys, "v", place.alias("at")).where(F.col("at") <= max(max_codes, SAMPLES))
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("listed"))
    short = F.col("n_distinct") <= max_codes
    codes = F.when(short, F.array_join("listed", "|")).alias("codes")
    return null_safe(whole, listed, keys).select(*keys, "n_distinct", "date_order", codes, F.when(~short, F.array_join(F.slice("listed", 1, SAMPLES), "|")).alias("samples"))


def profile_columns(df: DataFrame, max_codes: int = MAX_CODES, rows: int | None = None) -> DataFrame:
    """A row a column: kind, rows, nulls, least, median, greatest, distinct values, date order, and short code lists.

    Whole columns, or those of the first `rows` rows, if given. Numbers and booleans get a median; text gets what `text_profile` tells. All
    columns share each job: one aggregate of the table, one of its texts by value, and the medians' rounds. `df` must be stable.
    """
    df = df if rows is None else stage(df.limit(rows))
    fields = [(f.name, F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema.fields]
    ends = {"number": lambda c: (F.min(c.cast("double")), F.max(c.cast("double"))), "time": lambda c: (F.min(c), F.max(c)), "text": lambda c: (F.lit(None), F.lit(None))}
    sums = []
    for name, c, kind in fields:
        low, high = ends[kind](c)
        number = kind == "number"
        known = {
            "column": F.lit(name), "kind": F.lit(kind), "n_rows": F.count("*"), "n_null": F.count(F.when(c.isNull(), 1)),
            "least": low if number else F.lit(None), "greatest": high if number else F.lit(None),
            "first": F.lit(None) if number else low, "last": F.lit(None) if number else high,
        }
        sums.append(F.struct(*(v.cast(_TYPES[k]).alias(k) for k, v in known.items())))
    whole = df.agg(F.array(*sums).alias("columns")).select(F.explode("columns").alias("c")).select("c.*")

    def long(kind: str, to: str, value: str) -> DataFrame:
        """(column, value) of all columns of a kind, none missing."""
        entries = [F.struct(F.lit(name).alias("column"), c.cast(to).alias(value)) for name, c, own in fields if own == kind]
        empty = F.array().cast(f"array<struct<column:string,{value}:{to}>>")
        return df.select(F.explode(F.array(*entries) if entries else empty).alias("e")).select("e.column", f"e.{value}").where(F.col(value).isNotNull())

    medians = exact_medians(long("number", "double", "value"), ["column"]).select("column", "median")
    texts = text_profile(stage(long("text", "string", "v").groupBy("column", "v").agg(F.count("*").alias("k"))), ["column"], max_codes)
    found, is_text = whole.join(medians, "column", "left").join(texts, "column", "left"), F.col("kind") == "text"
    empty = {"n_distinct": F.when(is_text, F.coalesce("n_distinct", F.lit(0))), "codes": F.when(is_text & F.col("n_distinct").isNull(), "").otherwise(F.col("codes"))}
    return found.withColumns(empty).select(*_TYPES)


def stored_srids(df: DataFrame, geometry: str = "geom", srid: str = "srid") -> DataFrame:
    """Distinct SRIDs of rows that have a geometry, sorted."""
    return df.where(F.col(geometry).isNotNull()).select(srid).distinct().orderBy(srid)


def geometry_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """(table, column, declared SRID) of each field whose metadata declare one; schemas only, no data."""
    return [(name, f.name, int(f.metadata["srid"])) for name, df in sorted(tables.items()) for f in df.schema.fields if "srid" in f.metadata]
