"""Mann-Kendall trends with Sen's slope, one row a bore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .levels import BASES, choose_basis, nan_to_null, require_columns, require_unique
from .monthly import as_series, coverage_columns, monthly_median
from .scan import null_safe
from .sufficiency import Thresholds, assess

CLASSES = ("rising", "falling", "no_trend", "insufficient_data")


def direction(p: Column, s: Column, alpha: float) -> Column:
    return F.when(p >= alpha, "no_trend").when(s > 0, "increasing").otherwise("decreasing")


def trend_class(basis: Column, moved: Column) -> Column:
    """Always the change of the level: a depth that grows is a falling level."""
    up = ((basis == BASES[0]) & (moved == "increasing")) | ((basis == BASES[1]) & (moved == "decreasing"))
    return F.when(moved == "no_trend", "no_trend").when(up, "rising").otherwise("falling")


def head_terms(basis: Column, slope: Column, lower: Column, upper: Column) -> list[Column]:
    """Slope and interval of the level; tau and z keep the sign of the series that was tested."""
    depth = basis == BASES[1]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return [finite(F.when(depth, -a).otherwise(b)) for a, b in ((slope, slope), (upper, lower), (lower, upper))]


def mann_kendall(series: DataFrame, alpha: float = 0.05, variance: str = "hamed_rao", decimals: int | None = None) -> DataFrame:
    """`series` (key, values array) with the test's columns and direction; null statistics under three values."""
    tested = series.withColumn("t", stats.test_udf(alpha, variance, decimals)("values")).select(*series.columns, "t.*")
    return tested.withColumns({"direction": F.when(F.col("p_value").isNotNull(), direction(F.col("p_value"), F.col("s"), alpha)), "variance_method": F.lit(variance)})


def sens_slope(series: DataFrame, times: str, alpha: float = 0.05) -> DataFrame:
    """`series` with slope, lower and upper of `values` over the array column `times`."""
    return series.withColumn("t", stats.slope_udf(alpha)("values", times)).select(*series.columns, "t.*")


def deseasonalise(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """`monthly` (key, month_idx, value) with the season taken out: values less the climatology of their detrended copy.

    The slope of a key, by months since its first, takes the trend out; medians by month of the year, grouped by key and month, are the
    season; both meet the values by their keys. Under three values nothing is detrended.
    """
    known = monthly.where("month_idx IS NOT NULL").select(key, "month_idx", "value")
    series = as_series(known, key).withColumn("t", F.transform("months", lambda m: (m - F.col("months")[0]).cast("double")))
    slope = F.when(F.size("values") >= 3, F.col("slope"))
    trend = sens_slope(series, "t").select(key, F.col("months")[0].alias("first"), F.coalesce(F.when(~F.isnan(slope), slope), F.lit(0.0)).alias("slope"))
    flat = null_safe(known, trend, [key]).withColumn("value", F.col("value") - F.col("slope") * (F.col("month_idx") - F.col("first")))
    season = flat.groupBy(key, (F.col("month_idx") % 12).alias("moy")).agg(F.median("value").alias("offset"))
    met = null_safe(known.withColumn("moy", F.col("month_idx") % 12), season, [key, "moy"])
    return met.select(key, "month_idx", (F.col("value") - F.col("offset")).alias("value"))


def tie_correction(values: DataFrame, key: str = "bore_id", value: str = "value") -> DataFrame:
    """(key, n, tie_correction, classic_variance, tied_pairs) from counts of equal values; built-ins only."""
    t = F.col("t").cast("double")
    n = F.sum("t").cast("double")
    ties = F.sum(t * (t - 1) * (2 * t + 5))
    return (
        values.groupBy(key, value)
        .agg(F.count("*").alias("t"))
        .groupBy(key)
        .agg(F.sum("t").alias("n"), ties.alias("tie_correction"), ((n * (n - 1) * (2 * n + 5) - ties) / 18).alias("classic_variance"), F.sum(t * (t - 1) / 2).alias("tied_pairs"))
    )


def bore_trends(
    readings: DataFrame,
    bores: DataFrame,
    thresholds: Thresholds | None = None,
    alpha: float = 0.05,
    variance: str = "hamed_rao",
    decimals: int | None = None,
    check: bool = True,
) -> DataFrame:
    """One audited row for each bore, readings or none.

    Readings collapse to monthly medians of their depth (the one large shuffle, keyed by bore and month), then to one row a bore,
    and only that row meets the collar: a bore's level is its collar less the depth, in every month. Rows that fail the gate carry reasons and no
    statistics. Readings of unknown bores give no row. `decimals` rounds what is compared and ranked (see the kernel); None takes
    values as they are.
    """
    require_columns(readings, "bore_id", "depth_to_water_m")
    require_columns(bores, "bore_id", "collar_rl_m_ahd")
    if check:
        require_unique(bores.where("bore_id IS NOT NULL"), "bore_id")
    monthly = monthly_median(readings.where("bore_id IS NOT NULL"), value="depth_to_water_m")
    gap = F.expr("array_max(transform(slice(months, 2, size(months)), (m, i) -> m - months[i] - 1))")
    pairs = F.array_sort(F.collect_list(F.when(F.col("month_idx").isNotNull(), F.struct("month_idx", "value"))))
    stats_ = (
        monthly.groupBy("bore_id")
        .agg(pairs.alias("series"), *coverage_columns(F.col("month_idx").isNotNull(), F.lit(None).cast("int")))
        .withColumns({"months": F.col("series.month_idx"), "values": F.col("series.value")})
        .withColumn("longest_gap_months", F.when(F.size("months") > 1, gap).otherwise(0).cast("long"))
        .drop("series")
    )
    collar = nan_to_null(F.col("collar_rl_m_ahd")).alias("collar")
    level = F.when(F.col("collar").isNull(), F.col("values")).otherwise(F.transform("values", lambda depth: F.col("collar") - depth))
    known = bores.select("bore_id", choose_basis(F.col("collar_rl_m_ahd")).alias("basis"), collar)
    every = known.join(stats_, "bore_id", "left").withColumn("values", level).drop("collar")
    zero = {"n_observations": 0, "n_months_present": 0, "n_months_total": 0, "longest_gap_months": 0, "distinct_years": 0, "months_covered": 0}
    judged = assess(every.fillna(zero | {"gap_fraction": 1.0, "span_years": 0.0}), thresholds)
    ok = F.col("sufficient")
    tested = judged.withColumn(
        "t",
        stats.trend_udf(alpha, variance, decimals)(F.when(ok, F.col("months")), F.when(ok, F.col("values")), ok & F.col("can_deseasonalise")),
    )
    slope = head_terms(F.col("basis"), F.col("t.slope"), F.col("t.lower"), F.col("t.upper"))
    moved = direction(F.col("t.p_value"), F.col("t.s"), alpha)
    return tested.select(
        "bore_id",
        "basis",
        F.when(ok, trend_class(F.col("basis"), moved)).otherwise(CLASSES[3]).alias("trend_class"),
        "insufficient_reason",
        "n_observations",
        "n_months_present",
        "span_years",
        "distinct_years",
        "gap_fraction",
        "longest_gap_months",
        (ok & F.col("can_deseasonalise")).alias("deseasonalised"),
        *(c.alias(n) for c, n in zip(slope, ("sens_slope_m_per_year", "sens_slope_lower", "sens_slope_upper"), strict=True)),
        F.col("t.p_value").alias("p_value"),
        F.col("t.tau").alias("tau"),
        F.col("t.z").alias("z_score"),
        F.when(ok, F.lit(variance)).alias("variance_method"),
        F.col("t.factor").alias("autocorrelation_factor"),
        F.col("t.effective_n").alias("effective_n"),
    )


__all__ = ["CLASSES", "as_series", "bore_trends", "deseasonalise", "direction", "head_terms", "mann_kendall", "sens_slope", "tie_correction", "trend_class"]
