"""The registered queries and, beside each, SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geodesy, naming
from ..functions.numbers import half_away
from ..operators import autocorrelation, checks, concordance, levels, monthly, profile, readings, sufficiency, trends
from ..sources import delimited, folder, inventory, layers
from ..staging import shared_dir
from . import bindings, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
Z95 = "1.9599639845400536"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: half_away(F.col(c), 6) for c in columns})


def _levels(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return levels.derive_levels(bindings.readings(spark, d, sparse), bindings.bores(spark, d, sparse))


def _monthly(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return monthly.monthly_median(levels.basis_values(_levels(spark, d, sparse)))


DENSE, SPARSE = bindings.sql(), bindings.sql(sparse=True)
COVERAGE = "bore_id, n_observations, n_months_present, n_months_total, round(gap_fraction, 6) AS gap_fraction, round(span_years, 6) AS span_years, longest_gap_months, distinct_years, months_covered"

# Levels and merging


@query(
    "derive_levels",
    _with(DENSE) + "SELECT bore_id, observed_at, depth_to_water_m, l_orderkey, l_linenumber, round(collar_rl_m_ahd, 6) AS collar_rl_m_ahd, round(level_m_ahd, 6) AS level_m_ahd, datum_status FROM level",
)
def derive_levels(spark, d):
    return _rounded(_levels(spark, d), "collar_rl_m_ahd", "level_m_ahd").drop("l_partkey", "l_suppkey")


@query(
    "datum_summary",
    _with(DENSE) + "SELECT count(*) AS n_readings, count(level_m_ahd) AS n_with_level, count(*) FILTER (datum_status = 'collar_rl_missing') AS n_without_collar FROM level",
)
def datum_summary(spark, d):
    return levels.datum_summary(_levels(spark, d))


@query(
    "choose_basis",
    _with(SPARSE) + "SELECT bore_id, CASE WHEN collar_rl_m_ahd IS NULL THEN 'depth_to_water_m' ELSE 'head_m_ahd' END AS basis, CASE WHEN collar_rl_m_ahd IS NULL THEN 'collar_rl_missing' ELSE 'collar_rl_known' END AS datum_status FROM bore",
)
def choose_basis(spark, d):
    collar = F.col("collar_rl_m_ahd")
    return bindings.bores(spark, d, sparse=True).select("bore_id", levels.choose_basis(collar).alias("basis"), levels.datum_status(collar).alias("datum_status"))


_FIRST = """first AS (
  SELECT bore_id, observed_at, depth_to_water_m, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM reading
  QUALIFY row_number() OVER (PARTITION BY bore_id, observed_at ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, depth_to_water_m) = 1
)"""


@query("first_wins", _with(DENSE, _FIRST) + "SELECT * FROM first")
def first_wins(spark, d):
    return readings.first_wins(bindings.readings(spark, d), bindings.ORDER)


@query(
    "merge_readings",
    _with(DENSE, _FIRST) + "SELECT f.* FROM first f ANTI JOIN (SELECT * FROM reading WHERE l_orderkey % 3 = 0) s ON f.bore_id = s.bore_id AND f.observed_at = s.observed_at",
)
def merge_readings(spark, d):
    """Stored: the readings of every third order; the batch: all."""
    every = bindings.readings(spark, d)
    return readings.merge_readings(every.where("l_orderkey % 3 = 0"), every, bindings.ORDER)


@query("delete_bores", _with(DENSE) + "SELECT r.bore_id, count(*) AS n_readings FROM reading r JOIN (SELECT * FROM bore WHERE bore_id % 7 <> 0) b USING (bore_id) GROUP BY ALL")
def delete_bores(spark, d):
    bores = bindings.bores(spark, d)
    _, kept = readings.delete_bores(bores.where("bore_id % 7 = 0"), bores, bindings.readings(spark, d))
    return kept.groupBy("bore_id").agg(F.count("*").alias("n_readings"))


_POINTS = "CAST(300000 + (s_suppkey % 200) * 1000 AS DOUBLE) AS x, CAST(7500000 + (s_suppkey % 300) * 1000 AS DOUBLE) AS y"


def _raw_bores(spark, d):
    key = F.col("bore_id")
    return bindings.bores(spark, d).withColumns({"x": 300000 + (key % 200) * 1000, "y": 7500000 + (key % 300) * 1000})


@query(
    "load_bores",
    _with(DENSE) + f"""SELECT bore_id, x, y, CAST(7853 AS INTEGER) AS srid, round(collar_rl_m_ahd, 6) AS collar_rl_m_ahd, CAST(NULL AS VARCHAR) AS collar_rl_source,
    CASE WHEN collar_rl_m_ahd IS NULL THEN 'collar_rl_missing' ELSE 'collar_rl_known' END AS datum_status, 'supplier' AS source_file, 'EPSG:7853' AS source_crs
    FROM bore JOIN (SELECT s_suppkey AS bore_id, {_POINTS} FROM supplier) USING (bore_id)""",
)
def load_bores(spark, d):
    return _rounded(tables.bore_table(_raw_bores(spark, d), "supplier", "EPSG:7853"), "collar_rl_m_ahd")


# Monthly series


@query("monthly_median", _with(DENSE) + "SELECT bore_id, month_idx, round(value, 6) AS value, n FROM monthly")
def monthly_median(spark, d):
    return _rounded(_monthly(spark, d), "value")


@query("monthly_median_sparse", _with(SPARSE) + "SELECT bore_id, month_idx, round(value, 6) AS value, n FROM monthly")
def monthly_median_sparse(spark, d):
    return _rounded(_monthly(spark, d, sparse=True), "value")


@query("monthly_median_bounded", _with(DENSE) + "SELECT bore_id, month_idx, round(value, 6) AS value, n FROM monthly")
def monthly_median_bounded(spark, d):
    """The same without a task that holds a month: each month's middle is narrowed down."""
    found = monthly.monthly_median(levels.basis_values(_levels(spark, d)), bounded=True)
    return _rounded(found, "value")


@query("series_coverage", _with(SPARSE) + f"SELECT {COVERAGE} FROM coverage")
def series_coverage(spark, d):
    return _rounded(monthly.series_coverage(_monthly(spark, d, sparse=True)), "gap_fraction", "span_years")


@query("longest_gap", _with(SPARSE) + "SELECT bore_id, longest_gap_months, distinct_years, months_covered FROM coverage")
def longest_gap(spark, d):
    return monthly.series_coverage(_monthly(spark, d, sparse=True)).select("bore_id", "longest_gap_months", "distinct_years", "months_covered")


@query(
    "monthly_grid",
    _with(SPARSE) + """SELECT s.bore_id, CAST(s.month_idx AS INTEGER) AS month_idx, round(m.value, 6) AS value, coalesce(m.n, 0) AS n
    FROM (SELECT bore_id, unnest(range(min(month_idx), max(month_idx) + 1)) AS month_idx FROM monthly GROUP BY bore_id) s LEFT JOIN monthly m USING (bore_id, month_idx)""",
)
def monthly_grid(spark, d):
    return _rounded(monthly.monthly_grid(_monthly(spark, d, sparse=True)), "value")


@query(
    "climatology",
    _with(SPARSE) + """SELECT b.bore_id, CAST(m.month AS INTEGER) AS month, round(median(v.value), 6) AS value FROM (SELECT DISTINCT bore_id FROM monthly) b CROSS JOIN range(1, 13) m(month)
    LEFT JOIN monthly v ON v.bore_id = b.bore_id AND v.month_idx % 12 + 1 = m.month GROUP BY ALL""",
)
def climatology(spark, d):
    return _rounded(monthly.climatology(_monthly(spark, d, sparse=True)), "value")


_AXES = """SELECT bore_id, month_idx, CAST(row_number() OVER (PARTITION BY bore_id ORDER BY month_idx) - 1 AS INTEGER) AS position,
  month_idx - min(month_idx) OVER (PARTITION BY bore_id) AS month_offset,
  round(date_diff('day', make_date(CAST(min(month_idx) OVER (PARTITION BY bore_id) // 12 AS BIGINT), CAST(min(month_idx) OVER (PARTITION BY bore_id) % 12 + 1 AS BIGINT), 1), make_date(CAST(month_idx // 12 AS BIGINT), CAST(month_idx % 12 + 1 AS BIGINT), 1)) / 365.25::DOUBLE, 6) AS elapsed_years FROM monthly"""


@query("time_axes", _with(SPARSE) + _AXES)
def time_axes(spark, d):
    return _rounded(monthly.with_positions(_monthly(spark, d, sparse=True)), "elapsed_years").select("bore_id", "month_idx", "position", "month_offset", "elapsed_years")


@query(
    "average_rank",
    "SELECT l_suppkey AS bore_id, l_orderkey, l_linenumber, l_quantity AS value, CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS DOUBLE) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem",
)
def average_rank(spark, d):
    values = bindings.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("bore_id"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    return monthly.average_rank(values, "bore_id", "value")


# Sufficiency


def _assess(limits: sufficiency.Thresholds) -> tuple[str, Query]:
    sql = _with(SPARSE, bindings.assessed_sql(limits)) + "SELECT bore_id, sufficient, insufficient_reason, can_deseasonalise FROM assessed"

    def run(spark, d):
        found = sufficiency.assess(monthly.series_coverage(_monthly(spark, d, sparse=True)), limits)
        return found.select("bore_id", "sufficient", "insufficient_reason", "can_deseasonalise")

    return sql, run


for _name, _limits in (("assess", bindings.LIMITS), ("assess_defaults", sufficiency.Thresholds())):
    _sql, _run = _assess(_limits)
    query(_name, _sql)(_run)

# Statistics of the monthly series. In SQL by pairs of months; the library's kernel works on arrays.

_X = "x AS (SELECT bore_id, month_idx, round(value, 9) AS v, row_number() OVER (PARTITION BY bore_id ORDER BY month_idx) - 1 AS i, count(*) OVER (PARTITION BY bore_id) AS n FROM monthly)"


def stats_sql(x: str, name: str) -> str:
    """CTEs over `x` (bore_id, i, v): s, ties and variance by bore."""
    return f"""
{name}_s AS (SELECT a.bore_id, CAST(sum(sign(b.v - a.v)) AS DOUBLE) AS s FROM {x} a JOIN {x} b ON a.bore_id = b.bore_id AND a.i < b.i GROUP BY a.bore_id),
{name}_t AS (
  SELECT bore_id, sum(t)::DOUBLE AS n, sum(t::DOUBLE * (t - 1) * (2 * t + 5)) AS tie_correction, sum(t::DOUBLE * (t - 1) / 2) AS tied_pairs
  FROM (SELECT bore_id, v, count(*) AS t FROM {x} GROUP BY ALL) GROUP BY bore_id
),
{name}_v AS (SELECT *, (n * (n - 1) * (2 * n + 5) - tie_correction) / 18 AS var FROM {name}_t)"""


def slope_sql(x: str, name: str, time: str) -> str:
    """CTE of slope, lower, upper by bore over `x` with time column `time`; needs {x}'s variance as {name}_v."""
    return f"""
{name}_p AS (SELECT a.bore_id, (b.v - a.v) / (b.{time} - a.{time})::DOUBLE AS slope FROM {x} a JOIN {x} b ON a.bore_id = b.bore_id AND a.i < b.i WHERE b.{time} <> a.{time}),
{name}_l AS (SELECT bore_id, list(slope ORDER BY slope) AS l, count(*) AS m FROM {name}_p GROUP BY bore_id),
{name}_slope AS (
  SELECT bore_id, CASE WHEN m % 2 = 1 THEN l[m // 2 + 1] ELSE (l[m // 2] + l[m // 2 + 1]) / 2 END AS slope,
    l[CAST(least(greatest(floor((m - {Z95} * sqrt(var)) / 2), 0), m - 1) AS BIGINT) + 1] AS lower,
    l[CAST(least(greatest(ceil((m + {Z95} * sqrt(var)) / 2), 0), m - 1) AS BIGINT) + 1] AS upper
  FROM {name}_l JOIN {name}_v USING (bore_id)
)"""


def factor_sql(x: str, name: str) -> str:
    """CTE of the variance factor by bore: average ranks of the detrended values, lags up to the first inside the bounds."""
    return f"""
{name}_d AS (SELECT x.bore_id, i, n, round(v - slope * i, 6) AS v FROM {x} x JOIN {name}_slope USING (bore_id)),
{name}_r AS (
  SELECT bore_id, i, n, rank() OVER (PARTITION BY bore_id ORDER BY v) + (count(*) OVER (PARTITION BY bore_id, v) - 1) / 2.0::DOUBLE - (n + 1) / 2.0::DOUBLE AS r FROM {name}_d
),
{name}_q AS (SELECT bore_id, sum(r * r) AS q FROM {name}_r GROUP BY bore_id),
{name}_a AS (
  SELECT a.bore_id, b.i - a.i AS lag, a.n, a.n - (b.i - a.i) AS m, sum(a.r * b.r) / any_value(q) AS rho
  FROM {name}_r a JOIN {name}_r b ON a.bore_id = b.bore_id AND a.i < b.i JOIN {name}_q q ON q.bore_id = a.bore_id WHERE q > 0 GROUP BY a.bore_id, b.i - a.i, a.n
),
{name}_stop AS (SELECT bore_id, min(lag) AS stop FROM {name}_a WHERE m < 3 OR (rho * m > -1 - {Z95} * sqrt(m - 1) AND rho * m < -1 + {Z95} * sqrt(m - 1)) GROUP BY bore_id),
{name}_f AS (
  SELECT v.bore_id, greatest(1 + coalesce(2.0::DOUBLE / (any_value(v.n) * (any_value(v.n) - 1) * (any_value(v.n) - 2)) * sum(a.m::DOUBLE * (a.m - 1) * (a.m - 2) * a.rho), 0), 1e-6) AS factor
  FROM {name}_v v LEFT JOIN {name}_stop s USING (bore_id) LEFT JOIN {name}_a a ON a.bore_id = v.bore_id AND a.lag < s.stop GROUP BY v.bore_id
)"""


PHI_TAIL = """(1 - 2 * exp(0 - z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(z) - (lgamma(k + 1.5::DOUBLE) + (k + 1) * ln(2.0::DOUBLE) - 0.5::DOUBLE * ln(pi())))))) """


def test_sql(name: str, factor: str) -> str:
    """CTE of z, p and tau by bore from {name}_s, {name}_v and a factor expression."""
    return f"""
{name}_z AS (
  SELECT bore_id, v.n, s, var * {factor} AS var_s, {factor} AS factor, tied_pairs,
    CASE WHEN var * {factor} > 0 THEN abs(s - sign(s)) / sqrt(var * {factor}) ELSE 0 END AS z, CASE WHEN s < 0 THEN -1 ELSE 1 END AS side
  FROM {name}_v v JOIN {name}_s USING (bore_id) JOIN {name}_f USING (bore_id)
),
{name}_m AS (
  SELECT bore_id, n, s, var_s, side * z AS z, CASE WHEN z = 0 THEN 1.0 WHEN z > 7 THEN 0.0 ELSE {PHI_TAIL} END AS p_value, factor, n / factor AS effective_n,
    CASE WHEN n * (n - 1) / 2 > tied_pairs THEN s / sqrt((n * (n - 1) / 2 - tied_pairs) * (n * (n - 1) / 2)) ELSE 0 END AS tau
  FROM {name}_z
)"""


def _series(spark, d):
    found = _monthly(spark, d)
    return monthly.as_series(found.withColumn("value", half_away(F.col("value"), 9)))


@query("kendall_s", _with(DENSE, _X, stats_sql("x", "x")) + "SELECT bore_id, CAST(n AS INTEGER) AS n, s FROM x_s JOIN x_v USING (bore_id)")
def kendall_s(spark, d):
    values = _monthly(spark, d).withColumn("value", half_away(F.col("value"), 9))
    return concordance.kendall_s(values, "bore_id", ["month_idx"]).withColumn("n", F.col("n").cast("int"))


_QUANTITY = "x AS (SELECT l_partkey AS bore_id, l_quantity AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)"


@query(
    "tie_correction",
    _with(_QUANTITY, stats_sql("x", "x")) + "SELECT bore_id, CAST(n AS BIGINT) AS n, tie_correction, round(var, 6) AS classic_variance, tied_pairs FROM x_v",
)
def tie_correction(spark, d):
    values = bindings.table(spark, d, "lineitem").select(F.col("l_partkey").alias("bore_id"), F.col("l_quantity").alias("value"))
    return _rounded(trends.tie_correction(values), "classic_variance")


_MEDIANS = """x AS (SELECT bore_id, v, row_number() OVER (PARTITION BY bore_id ORDER BY m) - 1 AS i FROM (
  SELECT l_partkey AS bore_id, year(l_shipdate) * 12 + month(l_shipdate) AS m, median(l_quantity) AS v FROM lineitem GROUP BY ALL))"""


_TAU = "SELECT bore_id, s, round(s / sqrt((n * (n - 1) / 2 - tied_pairs) * (n * (n - 1) / 2)), 6) AS tau, round(var, 6) AS var_s FROM x_s JOIN x_v USING (bore_id) WHERE n > 2 AND n * (n - 1) / 2 > tied_pairs"


def _tau_b(values, order):
    counted = trends.tie_correction(values).drop("n")
    found = concordance.kendall_s(values, "bore_id", order).join(counted, "bore_id").where("n > 2 AND n * (n - 1) / 2 > tied_pairs")
    tau = concordance.tau_b(F.col("n").cast("double"), F.col("s"), F.col("tied_pairs"))
    return _rounded(found.select("bore_id", "s", tau.alias("tau"), F.col("classic_variance").alias("var_s")), "tau", "var_s")


@query("tau_b", _with(_MEDIANS, stats_sql("x", "x")) + _TAU)
def tau_b(spark, d):
    """Monthly medians of quantities, which have many ties."""
    line = bindings.table(spark, d, "lineitem")
    readings = line.select(F.col("l_partkey").alias("bore_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_quantity").alias("value"))
    return _tau_b(monthly.monthly_median(readings), ["month_idx"])


@query("tau_b_readings", _with(_QUANTITY, stats_sql("x", "x")) + _TAU)
def tau_b_readings(spark, d):
    """Every quantity of a part in order of time: series of any length."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    values = bindings.table(spark, d, "lineitem").select(F.col("l_partkey").alias("bore_id"), F.col("l_quantity").alias("value"), *order)
    return _tau_b(values, order)


@query(
    "sens_slope",
    _with(DENSE, _X, stats_sql("x", "x"), slope_sql("x", "x", "month_idx")) + "SELECT bore_id, round(slope, 6) AS slope, round(lower, 6) AS lower, round(upper, 6) AS upper FROM x_slope",
)
def sens_slope(spark, d):
    """Per month, by gap-aware month."""
    series = _series(spark, d).withColumn("t", F.col("months").cast("array<double>"))
    return _rounded(trends.sens_slope(series, "t"), "slope", "lower", "upper").select("bore_id", "slope", "lower", "upper")


_MK = "SELECT bore_id, CAST(n AS INTEGER) AS n, s, round(var_s, 6) AS var_s, round(z, 6) AS z, round(p_value, 6) AS p_value, round(tau, 6) AS tau, round(factor, 6) AS factor, CASE WHEN p_value >= 0.05 THEN 'no_trend' WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM x_m"


def _tested(spark, d, variance):
    found = trends.mann_kendall(_series(spark, d), variance=variance, decimals=6)
    return _rounded(found, "var_s", "z", "p_value", "tau", "factor").select("bore_id", "n", "s", "var_s", "z", "p_value", "tau", "factor", "direction")


@query("mann_kendall_classic", _with(DENSE, _X, stats_sql("x", "x"), "x_f AS (SELECT bore_id, 1.0::DOUBLE AS factor FROM x_v)", test_sql("x", "factor")) + _MK)
def mann_kendall_classic(spark, d):
    return _tested(spark, d, "classic")


_ROBUST = (stats_sql("x", "x"), slope_sql("x", "x", "i"), factor_sql("x", "x"), test_sql("x", "factor"))


@query("mann_kendall", _with(DENSE, _X, *_ROBUST) + _MK)
def mann_kendall(spark, d):
    return _tested(spark, d, "hamed_rao")


@query("hamed_rao_factor", _with(DENSE, _X, *_ROBUST) + "SELECT bore_id, round(factor, 6) AS factor, round(effective_n, 6) AS effective_n FROM x_m")
def hamed_rao_factor(spark, d):
    """Detrended by the slope a position; short series by the kernel, ranks and lags of long ones on Spark."""
    series = _series(spark, d).withColumn("t", F.transform("values", lambda _, i: i.cast("double")))
    sloped = trends.sens_slope(series, "t").select("bore_id", "slope", F.posexplode("values").alias("position", "value"))
    flat = sloped.select("bore_id", "position", half_away(F.col("value") - F.coalesce("slope", F.lit(0.0)) * F.col("position"), 6).alias("value"))
    return _rounded(autocorrelation.variance_factor(flat, "bore_id", short=autocorrelation.SHORT), "factor", "effective_n").select("bore_id", "factor", "effective_n")


# Deseasonalising and the flagship


def season_sql() -> str:
    """CTE adj (bore_id, month_idx, i, n, v): x less the climatology of its detrended copy."""
    return f"""{stats_sql("x", "raw")}, {slope_sql("x", "raw", "month_idx")},
flat AS (SELECT x.bore_id, x.month_idx, v - CASE WHEN n >= 3 THEN slope ELSE 0 END * (month_idx - min(month_idx) OVER (PARTITION BY x.bore_id)) AS f FROM x LEFT JOIN raw_slope USING (bore_id)),
clim AS (SELECT bore_id, month_idx % 12 AS moy, median(f) AS c FROM flat GROUP BY ALL),
season AS (SELECT x.bore_id, x.month_idx, x.i, x.n, v - c AS v FROM x JOIN clim ON clim.bore_id = x.bore_id AND clim.moy = x.month_idx % 12)"""


@query("deseasonalise", _with(DENSE, _X, season_sql()) + "SELECT bore_id, month_idx, round(v, 9) AS value FROM season")
def deseasonalise(spark, d):
    values = _monthly(spark, d).withColumn("value", half_away(F.col("value"), 9))
    return trends.deseasonalise(values).withColumn("value", half_away(F.col("value"), 9))


def trends_sql(sparse: bool) -> str:
    """The flagship; the pairs are only made for bores that pass the gate."""
    x = _X.replace("FROM monthly", "FROM monthly JOIN assessed USING (bore_id) WHERE sufficient AND bore_id IN (SELECT bore_id FROM bore)")
    start = "make_date(CAST({0} // 12 AS BIGINT), CAST({0} % 12 + 1 AS BIGINT), 1)"
    y = f"""y AS (
      SELECT x.bore_id, x.month_idx, x.i, x.n, round(CASE WHEN can_deseasonalise THEN season.v ELSE x.v END, 9) AS v,
        date_diff('day', {start.format("min(x.month_idx) OVER (PARTITION BY x.bore_id)")}, {start.format("x.month_idx")}) / 365.25::DOUBLE AS years
      FROM x JOIN season ON season.bore_id = x.bore_id AND season.i = x.i JOIN assessed a ON a.bore_id = x.bore_id
    )"""
    year = slope_sql("y", "yr", "years").replace("yr_v", "y_v")
    return (
        _with(bindings.sql(sparse), bindings.assessed_sql(bindings.LIMITS), x, season_sql(), y, stats_sql("y", "y"), slope_sql("y", "y", "i"), factor_sql("y", "y"), test_sql("y", "factor"), year)
        + """SELECT b.bore_id, CASE WHEN collar_rl_m_ahd IS NULL THEN 'depth_to_water_m' ELSE 'head_m_ahd' END AS basis,
      CASE WHEN m.p_value IS NULL THEN 'insufficient_data' WHEN m.p_value >= 0.05 THEN 'no_trend' WHEN (m.s > 0) = (collar_rl_m_ahd IS NOT NULL) THEN 'rising' ELSE 'falling' END AS trend_class,
      CASE WHEN a.bore_id IS NULL THEN 'only 0 observations (need 20); record spans 0.0 years (need 6); only 0 distinct years (need 5); 100% of months missing (limit 70%)' ELSE insufficient_reason END AS insufficient_reason,
      coalesce(n_observations, 0) AS n_observations, coalesce(n_months_present, 0) AS n_months_present, round(coalesce(span_years, 0), 6) AS span_years,
      coalesce(distinct_years, 0) AS distinct_years, round(coalesce(gap_fraction, 1), 6) AS gap_fraction, coalesce(longest_gap_months, 0) AS longest_gap_months,
      coalesce(sufficient AND can_deseasonalise, false) AS deseasonalised,
      round(CASE WHEN collar_rl_m_ahd IS NULL THEN 0 - slope ELSE slope END, 6) AS sens_slope_m_per_year,
      round(CASE WHEN collar_rl_m_ahd IS NULL THEN 0 - upper ELSE lower END, 6) AS sens_slope_lower,
      round(CASE WHEN collar_rl_m_ahd IS NULL THEN 0 - lower ELSE upper END, 6) AS sens_slope_upper,
      round(m.tau, 6) AS tau, round(m.p_value, 6) AS p_value, round(m.z, 6) AS z_score, round(m.factor, 6) AS autocorrelation_factor, round(m.effective_n, 6) AS effective_n, CASE WHEN m.p_value IS NOT NULL THEN 'hamed_rao' END AS variance_method
    FROM bore b LEFT JOIN assessed a USING (bore_id) LEFT JOIN y_m m USING (bore_id) LEFT JOIN yr_slope USING (bore_id)"""
    )


def _trends(spark, d, sparse=False, limits=bindings.LIMITS):
    """Values are rounded to nine decimals, detrended ones to six before ranking, here and in SQL; see the README on what hangs on the last bits."""
    bores = bindings.bores(spark, d, sparse)
    return trends.bore_trends(bindings.readings(spark, d, sparse), bores, limits, decimals=6)


_STATS = (
    "span_years", "gap_fraction", "sens_slope_m_per_year", "sens_slope_lower", "sens_slope_upper", "tau", "p_value", "z_score", "autocorrelation_factor", "effective_n",
)


@query("bore_trends", trends_sql(sparse=False))
def bore_trends(spark, d):
    return _rounded(_trends(spark, d), *_STATS)


@query("bore_trends_sparse", trends_sql(sparse=True))
def bore_trends_sparse(spark, d):
    return _rounded(_trends(spark, d, sparse=True), *_STATS)


@query("trend_geom", trends_sql(sparse=False).replace("FROM bore b LEFT", f", x, y, CAST(7853 AS INTEGER) AS srid, CASE WHEN collar_rl_m_ahd IS NULL THEN 'collar_rl_missing' ELSE 'collar_rl_known' END AS datum_status FROM bore b JOIN (SELECT s_suppkey AS bore_id, {_POINTS} FROM supplier) USING (bore_id) LEFT"))
def trend_geom(spark, d):
    bores = tables.bore_table(_raw_bores(spark, d), "supplier", "EPSG:7853")
    return _rounded(tables.trend_layer(bore_trends(spark, d), bores), "x", "y").drop("collar_rl_m_ahd")


_WRITTEN = ("bore_id", "basis", "insufficient_reason", "n_observations", "n_months_present", "span_years", "distinct_years", "gap_fraction", "longest_gap_months")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_trends", f"SELECT {', '.join(_WRITTEN)} FROM ({trends_sql(sparse=True)})")
def write_trends(spark, d):
    """The trend table as written and read again."""
    path = _scratch(spark, "trends")
    tables.write_trends(bindings.readings(spark, d, True), bindings.bores(spark, d, True), path, bindings.LIMITS)
    return _rounded(spark.read.parquet(path).select(*_WRITTEN), "span_years", "gap_fraction")


@query(
    "write_layers",
    _with(DENSE) + "SELECT layer, CAST(7853 AS INTEGER) AS srid, count(*) AS n_rows, count(collar_rl_m_ahd) AS n_known FROM (SELECT 'bore' AS layer, * FROM bore UNION ALL SELECT 'unmeasured', * FROM bore WHERE collar_rl_m_ahd IS NULL) GROUP BY layer",
)
def write_layers(spark, d):
    """Two versions of the bores' layers published over each other; what readers see is the second."""
    path, bores = _scratch(spark, "maps"), tables.bore_table(_raw_bores(spark, d), "supplier", "EPSG:7853")
    layers.publish_version(path, {"bore": bores.where("bore_id % 2 = 0"), "gone": bores})
    layers.publish_version(path, {"bore": bores, "unmeasured": bores.where("collar_rl_m_ahd IS NULL")})
    found = [df.withColumn("layer", F.lit(name)) for name, df in layers.published(spark, path).items()]
    return reduce(DataFrame.unionByName, found).groupBy("layer", "srid").agg(F.count("*").alias("n_rows"), F.count("collar_rl_m_ahd").alias("n_known"))


@query("geometry_columns", "SELECT 'bore' AS \"table\", c AS \"column\", 7853 AS declared, count(*) AS n_rows, count(*) AS n_as_declared FROM supplier CROSS JOIN (VALUES ('x'), ('y')) t(c) GROUP BY c")
def geometry_columns(spark, d):
    """Declared codes of the bore table's coordinates as stored, with how many rows have them."""
    path, bores = _scratch(spark, "bores"), tables.bore_table(_raw_bores(spark, d), "supplier", "EPSG:7853")
    bores.withMetadata("x", {"srid": 7853}).withMetadata("y", {"srid": 7853}).write.parquet(path)
    stored = spark.read.parquet(path)
    declared = spark.createDataFrame(profile.geometry_columns({"bore": stored}), "table string, column string, declared int")
    counts = stored.groupBy("srid").agg(F.count("*").alias("n"))
    met = declared.crossJoin(counts)  # a row a code
    return met.groupBy("table", "column", "declared").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("srid") == F.col("declared"), F.col("n")).otherwise(0)).alias("n_as_declared"))


# Names, dates, profiles


@query(
    "excluded_theme",
    """WITH n AS (SELECT p_partkey, p_name, CASE p_partkey % 8 WHEN 0 THEN p_name || '_springs' WHEN 1 THEN 'SacredSite' || p_partkey WHEN 2 THEN 'mainspring_' || p_name WHEN 3 THEN 'Soak-' || p_type WHEN 4 THEN 'springbank hall' ELSE p_type END AS name FROM part),
    t AS (SELECT p_partkey, name, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))) AS tokens FROM n)
    SELECT p_partkey, name, array_to_string(tokens, ' ') AS tokens, CASE WHEN list_has_any(tokens, ['spring', 'springs']) THEN 'spring' WHEN list_has_any(tokens, ['soak', 'soaks', 'soakage', 'soakages']) THEN 'soakage'
      WHEN list_has_any(tokens, ['sacred', 'sacredsite', 'sacredsites']) THEN 'sacred' END AS theme FROM t""",
)
def excluded_theme(spark, d):
    part, k = bindings.table(spark, d, "part"), F.col("p_partkey") % 8
    name = (
        F.when(k == 0, F.concat("p_name", F.lit("_springs"))).when(k == 1, F.concat(F.lit("SacredSite"), F.col("p_partkey").cast("string")))
        .when(k == 2, F.concat(F.lit("mainspring_"), "p_name")).when(k == 3, F.concat(F.lit("Soak-"), "p_type")).when(k == 4, "springbank hall").otherwise(F.col("p_type"))
    )
    named = part.select("p_partkey", name.alias("name"))
    return named.select("p_partkey", "name", F.array_join(F.array_sort(naming.name_tokens(F.col("name"))), " ").alias("tokens"), naming.excluded_theme(F.col("name")).alias("theme"))


@query(
    "human_bytes",
    """SELECT o_orderkey, b AS bytes, CASE WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN format('{:.1f}KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN format('{:.1f}MB', b / 1048576.0::DOUBLE) ELSE format('{:.1f}GB', b / 1073741824.0::DOUBLE) END AS size
    FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 2053 + 7 AS BIGINT) AS b FROM orders)""",
)
def human_bytes(spark, d):
    sized = bindings.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 2053 + 7).alias("bytes"))
    return sized.withColumn("size", naming.human_bytes(F.col("bytes")))


def _dated(spark, d):
    """Order dates as text, day first; of odd customers only such as can be read either way."""
    orders = bindings.table(spark, d, "orders")
    day_first, year_first = F.date_format("o_orderdate", "d/M/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.element_at(F.array(*map(F.lit, ("year", "day", "either", "code"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    text = F.when(kind == "year", year_first).when(kind == "day", day_first).when(kind == "either", F.when(F.dayofmonth("o_orderdate") <= 12, day_first)).otherwise(F.col("o_orderpriority"))
    return orders.select("o_orderkey", "o_orderdate", kind.alias("kind"), text.alias("text"))


_DATED = """dated AS (SELECT o_orderkey, o_orderdate, kind, CASE kind WHEN 'year' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'day' THEN strftime(o_orderdate, '%-d/%-m/%Y')
  WHEN 'either' THEN CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%-d/%-m/%Y') END ELSE o_orderpriority END AS text
  FROM (SELECT *, ['year', 'day', 'either', 'code'][o_custkey % 4 + 1] AS kind FROM orders))"""


@query(
    "date_order",
    _with(_DATED) + """SELECT kind, count(*) AS n_rows, CASE WHEN count(m) < 3 OR count(m) * 5 < count(text) * 4 THEN NULL WHEN max(a) > 31 THEN 'year_first' WHEN max(a) > 12 THEN 'day_first' WHEN max(b) > 12 THEN 'month_first' ELSE 'ambiguous' END AS date_order
    FROM (SELECT *, CASE WHEN text IS NOT NULL AND regexp_matches(text, '^\\s*\\d{1,4}[/-]\\d{1,2}[/-]\\d{1,4}') THEN 1 END AS m,
      try_cast(regexp_extract(text, '^\\s*(\\d{1,4})[/-](\\d{1,2})[/-](\\d{1,4})', 1) AS INTEGER) AS a, try_cast(regexp_extract(text, '^\\s*(\\d{1,4})[/-](\\d{1,2})[/-](\\d{1,4})', 2) AS INTEGER) AS b FROM dated) GROUP BY kind""",
)
def date_order(spark, d):
    return _dated(spark, d).groupBy("kind").agg(F.count("*").alias("n_rows"), dates.date_order(F.col("text")).alias("date_order"))


@query("parse_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS text, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 13 HOUR AS long FROM orders")
def parse_dates(spark, d):
    """All order dates as text of two kinds, one with names of months and a twelve-hour clock."""
    written = {"text": F.date_format("o_orderdate", "d/M/yyyy"), "long": F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" at 01.00 PM"))}
    orders = bindings.table(spark, d, "orders").select("o_orderkey", *(c.alias(name) for name, c in written.items()))
    return dates.parse_dates(orders, {"text": "%d/%m/%Y", "long": "%B %d, %Y at %I.%M %p", "not_there": "%Y"})


@query(
    "read_delimited",
    """SELECT s_suppkey AS RN, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS SITE, CAST(DATE '2005-01-13' + CAST(s_suppkey AS INTEGER) AS TIMESTAMP) AS MEAS_DATE,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS DTW, 'supplier' AS source_file FROM supplier""",
)
def read_delimited(spark, d):
    """Suppliers as a delimited table of text, typed as declared; what isn't there is told in several ways."""
    key = F.col("s_suppkey")
    text = bindings.table(spark, d, "supplier").select(
        key.cast("string").alias("RN"),
        F.when(key % 6 == 0, "n/a").otherwise(F.col("s_name")).alias("SITE"),
        F.date_format(F.date_add(F.lit("2005-01-13").cast("date"), key.cast("int")), "d/M/yyyy").alias("MEAS_DATE"),
        F.when(key % 8 == 0, "").when(key % 4 == 0, "NULL").otherwise(F.col("s_acctbal").cast("string")).alias("DTW"),
    )
    source = delimited.Source("", "supplier", date_formats={"MEAS_DATE": "%d/%m/%Y"}, types={"RN": "long", "DTW": "double"})
    return delimited.typed(text, source).withColumn("source_file", F.lit(source.name))


def _profile_sql(view: str, numbers: list[str], times: list[str], texts: list[str]) -> str:
    null = {"least": "NULL::DOUBLE", "median": "NULL::DOUBLE", "greatest": "NULL::DOUBLE", "first": "NULL::VARCHAR", "last": "NULL::VARCHAR", "n_distinct": "NULL::BIGINT", "date_order": "NULL::VARCHAR", "codes": "NULL::VARCHAR", "samples": "NULL::VARCHAR"}

    def part(c: str, kind: str, **known: str) -> str:
        return f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null, " + ", ".join(f'{x} AS "{n}"' for n, x in (null | known).items()) + f" FROM {view}"

    parts = [part(c, "number", least=f"min({c})::DOUBLE", median=f"median({c}::DOUBLE)", greatest=f"max({c})::DOUBLE") for c in numbers]
    parts += [part(c, "time", first=f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')", last=f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')") for c in times]
    parts += [part(c, "text", n_distinct=f"count(DISTINCT {c})", codes=f"CASE WHEN count(DISTINCT {c}) <= 12 THEN array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), '|') END",
        samples=f"CASE WHEN count(DISTINCT {c}) > 12 THEN array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL))[1:3], '|') END") for c in texts]
    return " UNION ALL ".join(parts)


@query("profile_orders", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"], ["o_orderstatus", "o_orderpriority"]))
def profile_orders(spark, d):
    return profile.profile_columns(bindings.table(spark, d, "orders"))


@query("profile_parts", _profile_sql("part", ["p_partkey", "p_size", "p_retailprice"], [], ["p_name", "p_brand", "p_type"]))
def profile_parts(spark, d):
    return profile.profile_columns(bindings.table(spark, d, "part"))


#: Tables that are written as delimited text, each with its delimiter, and the columns that hold numbers; the other ones are text.
_TEXTS = {
    "region": (",", ["r_regionkey", "r_name"]), "nation": ("\t", ["n_nationkey", "n_name", "n_regionkey"]), "supplier": ("|", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": (";", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), "customer": ("\t", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("|", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]), "events": (",", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
}
_TIMES = ("o_orderdate", "ts")
_WORDS = ("r_name", "n_name", "s_name", "p_name", "p_brand", "p_type", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "event_type", "props", *_TIMES)


def _inspect_sql() -> str:
    parts = []
    for view, (delimiter, columns) in _TEXTS.items():
        for at, c in enumerate(columns):
            v = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in _TIMES else c
            head = f"SELECT '{view}' AS source, {at} AS position, '{c}' AS \"column\", chr({ord(delimiter)}) AS delimiter, count(*) AS n_rows, count(*) - count({c}) AS n_null"
            if c in _WORDS:
                listed = f"list_sort(list(DISTINCT {v}) FILTER ({c} IS NOT NULL))"
                tail = f"""'text' AS kind, NULL::DOUBLE AS least, NULL::DOUBLE AS median, NULL::DOUBLE AS greatest, count(DISTINCT {v}) AS n_distinct, {"'year_first'" if c in _TIMES else "NULL::VARCHAR"} AS date_order,
                CASE WHEN count(DISTINCT {v}) <= 12 THEN array_to_string({listed}, '|') END AS codes, CASE WHEN count(DISTINCT {v}) > 12 THEN array_to_string({listed}[1:3], '|') END AS samples"""
            else:
                tail = f"'number' AS kind, min({c})::DOUBLE AS least, median({c}::DOUBLE) AS median, max({c})::DOUBLE AS greatest, NULL::BIGINT AS n_distinct, NULL::VARCHAR AS date_order, NULL::VARCHAR AS codes, NULL::VARCHAR AS samples"
            parts.append(f"{head}, {tail} FROM {view}")
    return " UNION ALL ".join(parts)


@query("inspect_files", _inspect_sql())
def inspect_files(spark, d):
    """Seven tables written as delimited text with four delimiters, each over as many files as it has parts, and inspected in one go."""
    root = f"{shared_dir(spark)}/inspect-{uuid.uuid4().hex}"
    paths = []
    for name, (delimiter, columns) in _TEXTS.items():
        text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in _TIMES else F.col(c) for c in columns]
        bindings.table(spark, d, name).select(text).write.csv(f"{root}/{name}", sep=delimiter, header=True, escape='"', quoteAll=name == "customer")
        paths.append(f"{root}/{name}")
    found = folder.inspect_files(spark, paths, by_folder=True)
    return found.withColumn("source", F.regexp_extract("source", "[^/]*$", 0))


@query("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, d):
    return delimited.row_count(bindings.table(spark, d, "lineitem"))


_FILES = "files AS (SELECT '/data/' || (p_partkey % 97) || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'Springs' ELSE p_brand END || (p_partkey // 10) || ['.shp', '.dbf', '.PRJ', '.csv', '.xlsx', '.zip', '.gpkg', '', '.doc', '.xml'][p_partkey % 10 + 1] AS path, p_partkey * p_size * 37 AS length FROM part)"


@query(
    "file_inventory",
    _with(_FILES) + """, p AS (SELECT path, length, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS suffix FROM files), q AS (SELECT *, left(path, length(path) - length(suffix)) AS base FROM p),
    k AS (SELECT *, regexp_extract(base, '[^/]*$') AS stem FROM q WHERE NOT (suffix IN ('.shx', '.dbf', '.prj', '.sbn', '.sbx', '.cpg', '.qix', '.qpj', '.xml') AND base IN (SELECT base FROM q WHERE suffix = '.shp')))
    SELECT path, stem, suffix, CASE WHEN suffix IN ('.shp', '.gpkg') THEN 'spatial' WHEN suffix = '.csv' THEN 'tabular' WHEN suffix = '.xlsx' THEN 'excel' WHEN suffix = '.zip' THEN 'archive' ELSE 'unrecognised' END AS kind,
      CASE WHEN length < 1024 THEN length || 'B' WHEN length < 1048576 THEN format('{:.1f}KB', length / 1024.0::DOUBLE) WHEN length < 1073741824 THEN format('{:.1f}MB', length / 1048576.0::DOUBLE) ELSE format('{:.1f}GB', length / 1073741824.0::DOUBLE) END AS size,
      CASE WHEN list_has_any(string_split_regex(lower(regexp_replace(stem, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), ['spring', 'springs']) THEN 'spring' END AS excluded_theme FROM k""",
)
def file_inventory(spark, d):
    """A listing made of the parts; names stand for the files of a large store."""
    key = F.col("p_partkey")
    ends = F.array(*map(F.lit, (".shp", ".dbf", ".PRJ", ".csv", ".xlsx", ".zip", ".gpkg", "", ".doc", ".xml")))
    stem = F.concat(F.when(key % 5 == 0, "Springs").otherwise(F.col("p_brand")), F.floor(key / 10).cast("string"))
    path = F.concat(F.lit("/data/"), (key % 97).cast("string"), F.lit("/"), stem, F.element_at(ends, (key % 10 + 1).cast("int")))
    return inventory.inventory(bindings.table(spark, d, "part").select(path.alias("path"), (key * F.col("p_size") * 37).alias("length")))


# Coordinates


def _lonlat(spark, d):
    key = F.col("s_suppkey")
    return bindings.table(spark, d, "supplier").select("s_suppkey", (132 + (key % 600) / F.lit(100.0)).alias("x"), (-26 + (key % 1600) / F.lit(100.0)).alias("y"), F.lit(7844).alias("epsg"))


def _project_sql(lon: str, lat: str) -> str:
    radius, forward, _ = geodesy._series()
    e = repr((geodesy._F * (2 - geodesy._F)) ** 0.5)
    x = "eta" + "".join(f" + {a!r} * cos({2 * i} * xi) * sinh({2 * i} * eta)" for i, a in enumerate(forward, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * i} * xi) * cosh({2 * i} * eta)" for i, a in enumerate(forward, 1))
    return f"""a AS (SELECT *, sin(radians({lat})) AS s, radians({lon} - 135) AS lam FROM p), b AS (SELECT *, sinh(atanh(s) - {e} * atanh({e} * s)) AS t FROM a),
    c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b),
    g AS (SELECT *, 500000 + {0.9996 * radius!r} * ({x}) AS east, 10000000 + {0.9996 * radius!r} * ({y}) AS north FROM c)"""


_LONLAT = "p AS (SELECT s_suppkey, 132 + (s_suppkey % 600) / 100.0::DOUBLE AS lon, -26 + (s_suppkey % 1600) / 100.0::DOUBLE AS lat FROM supplier)"


@query("to_grid_xy", _with(_LONLAT, _project_sql("lon", "lat")) + "SELECT s_suppkey, round(east, 4) AS x, round(north, 4) AS y, CAST(7853 AS INTEGER) AS srid FROM g")
def to_grid_xy(spark, d):
    moved = geodesy.to_grid_xy(_lonlat(spark, d))
    return moved.select("s_suppkey", half_away(F.col("x"), 4).alias("x"), half_away(F.col("y"), 4).alias("y"), "srid")


_NODE = "(((i * 7 + j * 3) % 5) / 1000000.0::DOUBLE)"


def _nodes(spark):
    """A made-up shift table for the check: real ones are files that a user supplies."""
    rows = [(i, j, ((i * 7 + j * 3) % 5) / 1e6, -(((i * 7 + j * 3) % 5) / 1e6)) for i in range(130, 140) for j in range(-28, -8)]
    return spark.createDataFrame(rows, "i long, j long, dlon double, dlat double")


@query(
    "to_grid_xy_shifted",
    _with(_LONLAT.replace("p AS", "p0 AS"), f"nodes AS (SELECT i, j, ((i * 7 + j * 3) % 5 + 5) % 5 / 1000000.0::DOUBLE AS s FROM range(130, 140) t(i), range(-28, -8) u(j))",
        "w AS (SELECT *, lon - floor(lon) AS u, lat - floor(lat) AS v FROM p0)",
        "p AS (SELECT s_suppkey, lon + z AS lon, lat - z AS lat FROM (SELECT w.*, a.s * (1 - u) * (1 - v) + b.s * u * (1 - v) + c.s * (1 - u) * v + d.s * u * v AS z FROM w JOIN nodes a ON a.i = floor(lon) AND a.j = floor(lat) JOIN nodes b ON b.i = floor(lon) + 1 AND b.j = floor(lat) JOIN nodes c ON c.i = floor(lon) AND c.j = floor(lat) + 1 JOIN nodes d ON d.i = floor(lon) + 1 AND d.j = floor(lat) + 1))",
        _project_sql("lon", "lat")) + "SELECT s_suppkey, round(east, 4) AS x, round(north, 4) AS y, CAST(7853 AS INTEGER) AS srid FROM g",
)
def to_grid_xy_shifted(spark, d):
    moved = geodesy.to_grid_xy(_lonlat(spark, d).withColumn("epsg", F.lit(4283)), _nodes(spark))
    return moved.select("s_suppkey", half_away(F.col("x"), 4).alias("x"), half_away(F.col("y"), 4).alias("y"), "srid")


_CODE = "CASE s_suppkey % 6 WHEN 0 THEN 7853 WHEN 1 THEN 7844 WHEN 2 THEN 4283 WHEN 3 THEN 28353 WHEN 4 THEN 4326 END"


def _codes(spark, d):
    k = F.col("s_suppkey") % 6
    code = F.when(k == 0, 7853).when(k == 1, 7844).when(k == 2, 4283).when(k == 3, 28353).when(k == 4, 4326)
    declared = F.when(F.col("s_suppkey") % 4 == 0, 7853).when(F.col("s_suppkey") % 4 == 1, code)
    return bindings.table(spark, d, "supplier").select("s_suppkey", code.alias("epsg"), declared.alias("declared"))


@query(
    "crs_verdict",
    f"""SELECT s_suppkey, epsg, CASE WHEN epsg IS NULL THEN NULL WHEN epsg IN (7853, 7844) THEN 'GDA2020' WHEN epsg IN (4283, 28353) THEN 'GDA94' ELSE 'other' END AS datum_family,
    CASE WHEN epsg IS NULL THEN 'none_declared' ELSE concat_ws(',', CASE WHEN epsg = 7853 THEN 'on_grid' END, CASE WHEN epsg IN (7844, 4283) THEN 'geographic_needs_projecting' END, CASE WHEN epsg IN (4283, 28353) THEN 'gda94_needs_shift_table' END) END AS notes,
    CASE WHEN epsg IS NULL AND declared IS NULL THEN 'none_declared' WHEN epsg <> declared THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN epsg IS NULL OR declared IS NULL OR epsg = declared THEN coalesce(epsg, declared) END AS resolved
    FROM (SELECT s_suppkey, {_CODE} AS epsg, CASE WHEN s_suppkey % 4 = 0 THEN 7853 WHEN s_suppkey % 4 = 1 THEN {_CODE} END AS declared FROM supplier)""",
)
def crs_verdict(spark, d):
    epsg = F.col("epsg")
    found = geodesy.resolve_source_crs(epsg, F.col("declared"))
    return _codes(spark, d).select("s_suppkey", "epsg", geodesy.datum_family(epsg).alias("datum_family"), F.array_join(geodesy.crs_verdict(epsg), ",").alias("notes"), found.status.alias("status"), found.epsg.alias("resolved"))


@query(
    "total_bounds",
    _with(_LONLAT, _project_sql("lon", "lat")) + """SELECT zone, round(min(east), 3) AS min_x, round(min(north), 3) AS min_y, round(max(east), 3) AS max_x, round(max(north), 3) AS max_y, count(*) FILTER (east BETWEEN 60000 AND 940000 AND north BETWEEN 7100000 AND 8900000) AS n_within,
    CASE WHEN min(east) BETWEEN -180 AND 180 AND min(north) BETWEEN -90 AND 90 AND abs(max(east)) <= 180 THEN 'lonlat' WHEN min(east) BETWEEN 100000 AND 900000 AND min(north) BETWEEN 6000000 AND 8000000 THEN 'mga_metres' ELSE 'neither' END AS verdict
    FROM (SELECT *, s_suppkey % 7 AS zone FROM g) GROUP BY zone""",
)
def total_bounds(spark, d):
    x, y = F.col("x"), F.col("y")
    grid = geodesy.to_grid_xy(_lonlat(spark, d)).withColumn("zone", F.col("s_suppkey") % 7)
    inside = grid.groupBy("zone").agg(F.count(F.when(geodesy.within_zone(x, y), 1)).alias("n_within"))
    bounds = geodesy.total_bounds(grid, by=("zone",)).join(inside, "zone")
    judged = bounds.withColumn("verdict", geodesy.coords_verdict(F.col("min_x"), F.col("min_y"), F.col("max_x")))
    return judged.withColumns({c: half_away(F.col(c), 3) for c in ("min_x", "min_y", "max_x", "max_y")})


# Layers and constraints


@query("stored_srids", f"SELECT DISTINCT {_CODE} AS srid FROM supplier WHERE s_acctbal > 0")
def stored_srids(spark, d):
    points = _codes(spark, d).join(bindings.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("geom")), "s_suppkey")
    return profile.stored_srids(points.withColumnRenamed("epsg", "srid"))


@query("select_layer", "SELECT n_nationkey, n_name, 'region_1' AS layer FROM nation WHERE n_regionkey = 1")
def select_layer(spark, d):
    nation = bindings.table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("layer"))
    return layers.select_layer(nation, "region_1")


@query(
    "verify_layers",
    """SELECT 'bore' AS layer, '7853' AS srids, count(*) AS n_rows FROM supplier UNION ALL
    SELECT 'mixed', array_to_string(list_sort(list(DISTINCT coalesce(e, -1))), ','), count(*) FROM (SELECT """ + _CODE + """ AS e FROM supplier)""",
)
def verify_layers(spark, d):
    on_grid = tables.bore_table(_raw_bores(spark, d), "supplier", "EPSG:7853")
    found = layers.stored_layer_srids({"bore": on_grid, "mixed": _codes(spark, d).withColumnRenamed("epsg", "srid")})
    return found.withColumn("srids", F.array_join(F.col("srids").cast("array<string>"), ","))


@query(
    "check_readings",
    _with(DENSE) + """SELECT 'water_level.unique' AS rule, bore_id || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS key, CAST(count(*) AS VARCHAR) AS detail FROM reading GROUP BY bore_id, observed_at HAVING count(*) > 1
    UNION ALL SELECT 'water_level.foreign_key', CAST(bore_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM reading ANTI JOIN bore USING (bore_id) GROUP BY bore_id""",
)
def check_readings(spark, d):
    return checks.check_readings(_levels(spark, d), bindings.bores(spark, d))


@query(
    "check_bores",
    """WITH b AS (SELECT s_suppkey AS bore_id, CASE WHEN s_suppkey % 5 <> 2 THEN s_acctbal END AS c, CASE s_suppkey % 9 WHEN 0 THEN 'surveyed' WHEN 1 THEN NULL ELSE CASE WHEN s_suppkey % 4 = 2 THEN 'collar_rl_missing' ELSE 'collar_rl_known' END END AS st, CASE WHEN s_suppkey % 13 = 0 THEN 4283 ELSE 7853 END AS srid FROM supplier)
    SELECT 'bore.datum_status.not_null' AS rule, CAST(bore_id AS VARCHAR) AS key, 'null' AS detail FROM b WHERE st IS NULL
    UNION ALL SELECT 'bore.datum_status', CAST(bore_id AS VARCHAR), st FROM b WHERE st NOT IN ('collar_rl_known', 'collar_rl_missing')
    UNION ALL SELECT 'bore.datum_status_agrees', CAST(bore_id AS VARCHAR), st FROM b WHERE NOT ((st = 'collar_rl_known' AND c IS NOT NULL) OR (st = 'collar_rl_missing' AND c IS NULL))
    UNION ALL SELECT 'bore.srid', CAST(bore_id AS VARCHAR), CAST(srid AS VARCHAR) FROM b WHERE srid <> 7853""",
)
def check_bores(spark, d):
    """Suppliers with flags, some of them wrong."""
    key = F.col("s_suppkey")
    status = F.when(key % 9 == 0, "surveyed").when(key % 9 != 1, F.when(key % 4 == 2, levels.MISSING).otherwise(levels.KNOWN))
    raw = bindings.table(spark, d, "supplier").select(key.alias("bore_id"), F.when(key % 5 != 2, F.col("s_acctbal")).alias("collar_rl_m_ahd"), status.alias("datum_status"), F.when(key % 13 == 0, 4283).otherwise(7853).alias("srid"))
    return checks.check_bores(raw)


@query("check_trends", "SELECT 'x' AS rule, 'x' AS key, 'x' AS detail FROM region WHERE false")
def check_trends(spark, d):
    """The flagship's own rows break no rule."""
    bores = bindings.bores(spark, d)
    return checks.check_trends(_trends(spark, d), bores)


_FAULTY = """t AS (SELECT s_suppkey - CASE WHEN s_suppkey % 37 = 5 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 41 = 1 THEN 1000000000 ELSE 0 END AS bore_id, CASE s_suppkey % 11 WHEN 3 THEN 'depth' WHEN 4 THEN NULL ELSE 'head_m_ahd' END AS basis,
  CASE s_suppkey % 7 WHEN 0 THEN 'insufficient_data' WHEN 1 THEN 'steady' WHEN 2 THEN NULL ELSE 'rising' END AS trend_class, CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 3 <> 0 OR s_suppkey % 17 = 1 THEN 'too short' END AS insufficient_reason,
  CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 19 <> 2 OR s_suppkey % 23 = 0 THEN 0.01 END AS p_value, CASE WHEN s_suppkey % 7 <> 0 THEN 1.5 END AS sens_slope_m_per_year, CASE WHEN s_suppkey % 29 <> 0 THEN 30 END AS n_observations FROM supplier)"""


@query(
    "check_trends_faulty",
    "WITH " + _FAULTY + """, b AS (SELECT s_suppkey AS bore_id FROM supplier)
    SELECT 'bore_trend.primary_key' AS rule, CAST(bore_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM t GROUP BY bore_id HAVING count(*) > 1
    UNION ALL SELECT 'bore_trend.' || c || '.not_null', CAST(bore_id AS VARCHAR), 'null' FROM (SELECT bore_id, unnest([CASE WHEN basis IS NULL THEN 'basis' END, CASE WHEN trend_class IS NULL THEN 'trend_class' END, CASE WHEN n_observations IS NULL THEN 'n_observations' END]) AS c FROM t) WHERE c IS NOT NULL
    UNION ALL SELECT 'bore_trend.trend_class', CAST(bore_id AS VARCHAR), trend_class FROM t WHERE trend_class NOT IN ('rising', 'falling', 'no_trend', 'insufficient_data')
    UNION ALL SELECT 'bore_trend.basis', CAST(bore_id AS VARCHAR), basis FROM t WHERE basis NOT IN ('head_m_ahd', 'depth_to_water_m')
    UNION ALL SELECT 'bore_trend.statistics', CAST(bore_id AS VARCHAR), trend_class FROM t WHERE NOT ((trend_class = 'insufficient_data' AND insufficient_reason IS NOT NULL AND p_value IS NULL AND sens_slope_m_per_year IS NULL) OR (trend_class <> 'insufficient_data' AND insufficient_reason IS NULL AND p_value IS NOT NULL))
    UNION ALL SELECT 'bore_trend.foreign_key', CAST(bore_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM t ANTI JOIN b USING (bore_id) GROUP BY bore_id""",
)
def check_trends_faulty(spark, d):
    """Trend rows with faults of every kind, one for each supplier."""
    k = F.col("s_suppkey")
    rows = bindings.table(spark, d, "supplier").select(
        (k - F.when(k % 37 == 5, 1).otherwise(0) + F.when(k % 41 == 1, bindings.UNKNOWN).otherwise(0)).alias("bore_id"),
        F.when(k % 11 == 3, "depth").when(k % 11 != 4, "head_m_ahd").alias("basis"),
        F.when(k % 7 == 0, "insufficient_data").when(k % 7 == 1, "steady").when(k % 7 != 2, "rising").alias("trend_class"),
        F.when((k % 7 == 0) & (k % 3 != 0) | (k % 17 == 1), "too short").alias("insufficient_reason"),
        F.when((k % 7 != 0) & (k % 19 != 2) | (k % 23 == 0), 0.01).alias("p_value"),
        F.when(k % 7 != 0, 1.5).alias("sens_slope_m_per_year"),
        F.when(k % 29 != 0, 30).alias("n_observations"),
    )
    return checks.check_trends(rows, bindings.table(spark, d, "supplier").select(k.alias("bore_id")))


@query(
    "check_readings_faulty",
    """WITH r AS (SELECT CASE WHEN l_orderkey % 101 = 3 THEN NULL WHEN l_suppkey % 41 = 1 THEN l_suppkey + 1000000000 ELSE l_suppkey END AS bore_id, CASE WHEN l_orderkey % 97 = 5 THEN NULL ELSE l_shipdate END AS observed_at, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS depth_to_water_m, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS level_m_ahd,
      CASE WHEN l_orderkey % 211 <> 0 THEN 'lineitem' END AS source_file FROM lineitem), b AS (SELECT s_suppkey AS bore_id FROM supplier)
    SELECT 'water_level.unique' AS rule, bore_id || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS key, CAST(count(*) AS VARCHAR) AS detail FROM r WHERE bore_id IS NOT NULL AND observed_at IS NOT NULL GROUP BY bore_id, observed_at HAVING count(*) > 1
    UNION ALL SELECT 'water_level.' || c || '.not_null', CAST(bore_id AS VARCHAR), 'null' FROM (SELECT bore_id, unnest([CASE WHEN bore_id IS NULL THEN 'bore_id' END, CASE WHEN observed_at IS NULL THEN 'observed_at' END, CASE WHEN source_file IS NULL THEN 'source_file' END]) AS c FROM r) WHERE c IS NOT NULL
    UNION ALL SELECT 'water_level.depth_or_level', CAST(bore_id AS VARCHAR), strftime(observed_at, '%Y-%m-%d %H:%M:%S') FROM r WHERE depth_to_water_m IS NULL AND level_m_ahd IS NULL
    UNION ALL SELECT 'water_level.foreign_key', CAST(bore_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM r ANTI JOIN b USING (bore_id) WHERE bore_id IS NOT NULL GROUP BY bore_id""",
)
def check_readings_faulty(spark, d):
    """Line items as readings with faults of every kind."""
    k = F.col("l_orderkey")
    rows = bindings.table(spark, d, "lineitem").select(
        F.when(k % 101 != 3, F.col("l_suppkey") + F.when(F.col("l_suppkey") % 41 == 1, bindings.UNKNOWN).otherwise(0)).alias("bore_id"),
        F.when(k % 97 != 5, F.col("l_shipdate")).alias("observed_at"),
        F.when(k % 5 != 0, F.col("l_quantity")).alias("depth_to_water_m"),
        F.when(k % 7 != 0, F.col("l_extendedprice")).alias("level_m_ahd"),
        F.when(k % 211 != 0, "lineitem").alias("source_file"),
    )
    return checks.check_readings(rows, bindings.table(spark, d, "supplier").select(F.col("s_suppkey").alias("bore_id")))


@query(
    "check_licences_faulty",
    """WITH l AS (SELECT c_custkey - CASE WHEN c_custkey % 43 = 7 THEN 1 ELSE 0 END AS licence_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS geom, CASE c_custkey % 5 WHEN 0 THEN 4283 WHEN 1 THEN NULL ELSE 7853 END AS srid, CASE WHEN c_custkey % 31 <> 2 THEN 'customer' END AS source_file FROM customer)
    SELECT 'licence.primary_key' AS rule, CAST(licence_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM l GROUP BY licence_id HAVING count(*) > 1
    UNION ALL SELECT 'licence.source_file.not_null', CAST(licence_id AS VARCHAR), 'null' FROM l WHERE source_file IS NULL
    UNION ALL SELECT 'licence.srid', CAST(licence_id AS VARCHAR), coalesce(CAST(srid AS VARCHAR), 'null') FROM l WHERE geom IS NOT NULL AND srid IS DISTINCT FROM 7853""",
)
def check_licences_faulty(spark, d):
    """Customers as licences, some without a shape, some with a wrong code."""
    k = F.col("c_custkey")
    rows = bindings.table(spark, d, "customer").select(
        (k - F.when(k % 43 == 7, 1).otherwise(0)).alias("licence_id"),
        F.when(k % 3 != 0, F.col("c_name")).alias("geom"),
        F.when(k % 5 == 0, 4283).when(k % 5 != 1, 7853).alias("srid"),
        F.when(k % 31 != 2, "customer").alias("source_file"),
    )
    return checks.check_licences(rows)
