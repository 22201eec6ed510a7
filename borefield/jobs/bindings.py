"""The domain's tables as the star schema's: suppliers or parts as bores, line items as readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_away
from ..operators.sufficiency import Thresholds

#: The records span under seven years, so the default limits leave none to test.
LIMITS = Thresholds(min_span_years=6.0, max_gap_fraction=0.70)
#: What is added to a bore's key where a reading has no bore.
UNKNOWN = 1_000_000_000
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "depth_to_water_m"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bores(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    if sparse:
        raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("bore_id"), (F.col("p_retailprice") / 10).alias("rl"))
    else:
        raw = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bore_id"), (300 + F.col("s_acctbal") / 100).alias("rl"))
    collar = F.when(F.col("bore_id") % 5 != 2, F.col("rl"))
    return raw.select("bore_id", collar.alias("collar_rl_m_ahd"))


def readings(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """Depths with a trend and a slow wave by bore, to four decimals so that every engine has the same.

    Those of every eleventh order are of bores that no table has, so that there are orphans.
    """
    key = F.col("l_partkey" if sparse else "l_suppkey")
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    depth = F.col("l_extendedprice") / 1000 + 5.0 * (year - 1995) * (key % 3 - 1) + 12 * F.sin((12 * year + month) / F.lit(9.0) + key)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 11 == 0, key + UNKNOWN).otherwise(key).alias("bore_id"), F.col("l_shipdate").alias("observed_at"), half_away(depth, 4).alias("depth_to_water_m"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


def sql(sparse: bool = False) -> str:
    """The same as SQL: common table expressions bore, reading, level, basis, monthly and coverage."""
    key, keep, collar, source = (
        ("l_partkey", "p_partkey", "p_retailprice / 10", "part") if sparse else ("l_suppkey", "s_suppkey", "300 + s_acctbal / 100", "supplier")
    )
    return f"""
bore AS (SELECT {keep} AS bore_id, CASE WHEN {keep} % 5 <> 2 THEN {collar} END AS collar_rl_m_ahd FROM {source}),
reading AS (
  SELECT CASE WHEN l_orderkey % 11 = 0 THEN {key} + {UNKNOWN} ELSE {key} END AS bore_id, l_shipdate AS observed_at, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice / 1000 + 5.0 * (year(l_shipdate) - 1995) * ({key} % 3 - 1) + 12 * sin((12 * year(l_shipdate) + month(l_shipdate)) / 9.0::DOUBLE + {key}), 4)
      AS depth_to_water_m FROM lineitem
),
level AS (
  SELECT r.*, b.collar_rl_m_ahd, b.collar_rl_m_ahd - r.depth_to_water_m AS level_m_ahd,
    CASE WHEN b.collar_rl_m_ahd IS NULL THEN 'collar_rl_missing' ELSE 'collar_rl_known' END AS datum_status
  FROM reading r LEFT JOIN bore b USING (bore_id)
),
basis AS (SELECT *, CASE WHEN collar_rl_m_ahd IS NULL THEN depth_to_water_m ELSE level_m_ahd END AS value FROM level),
monthly AS (
  SELECT bore_id, CAST(year(observed_at) * 12 + month(observed_at) - 1 AS INTEGER) AS month_idx, median(value) AS value, count(*) AS n
  FROM basis WHERE value IS NOT NULL GROUP BY ALL
),
coverage AS (
  SELECT bore_id, CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_months_present, CAST(max(month_idx) - min(month_idx) + 1 AS BIGINT) AS n_months_total,
    1 - count(*) / (max(month_idx) - min(month_idx) + 1) AS gap_fraction, (max(month_idx) - min(month_idx)) / 12.0::DOUBLE AS span_years,
    CAST(coalesce(max(gap), 0) AS BIGINT) AS longest_gap_months, count(DISTINCT month_idx // 12) AS distinct_years, count(DISTINCT month_idx % 12) AS months_covered
  FROM (SELECT *, month_idx - lag(month_idx) OVER (PARTITION BY bore_id ORDER BY month_idx) - 1 AS gap FROM monthly) GROUP BY bore_id
)"""


def assessed_sql(limits: Thresholds) -> str:
    """CTE assessed over coverage; ties of the printed figures go to even."""

    def even(top: str, bottom: str) -> str:
        return f"(({top}) // ({bottom}) + CASE WHEN 2 * (({top}) % ({bottom})) > ({bottom}) OR (2 * (({top}) % ({bottom})) = ({bottom}) AND (({top}) // ({bottom})) % 2 = 1) THEN 1 ELSE 0 END)"

    tenths = even("(n_months_total - 1) * 10", "12")
    return f"""
assessed AS (
  SELECT *, distinct_years >= {limits.min_years_for_climatology} AND months_covered >= {limits.min_months_for_climatology} AS can_deseasonalise,
    insufficient_reason IS NULL AS sufficient
  FROM (SELECT *, nullif(concat_ws('; ',
      CASE WHEN n_observations < {limits.min_observations} THEN 'only ' || n_observations || ' observations (need {limits.min_observations})' END,
      CASE WHEN span_years < {limits.min_span_years} THEN 'record spans ' || ({tenths} // 10) || '.' || ({tenths} % 10) || ' years (need {limits.min_span_years:.0f})' END,
      CASE WHEN distinct_years < {limits.min_distinct_years} THEN 'only ' || distinct_years || ' distinct years (need {limits.min_distinct_years})' END,
      CASE WHEN gap_fraction > {limits.max_gap_fraction}::DOUBLE THEN {even("(n_months_total - n_months_present) * 100", "n_months_total")} || '% of months missing (limit {limits.max_gap_fraction:.0%})' END
    ), '') AS insufficient_reason FROM coverage)
)"""
