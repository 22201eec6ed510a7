"""The variance factor of autocorrelated series, by a frontier of lags.

Ranks meet the ranks a few lags later, for all series at once. A series leaves the frontier at its first lag inside the bounds, so later
lags are never computed for it; the block of lags doubles for those that go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import factor_udf, quantile
from ..staging import stage
from .monthly import average_rank
from .scan import null_safe

#: Lags of the first round; values of a series up to which it is one array.
LAGS, SHORT = 4, 1 << 10


def _inside(rho: Column, m: Column, z: float) -> Column:
    """Whether a lag's correlation lies inside Anderson's bounds, which depend on the lag."""
    width = z * F.sqrt(m - 1)
    return (rho * m > -1 - width) & (rho * m < -1 + width)


def variance_factor(values: DataFrame, key: str, position: str = "position", value: str = "value", alpha: float = 0.05, lags: int = LAGS, short: int = 0) -> DataFrame:
    """(key, n, factor, effective_n) of detrended series: n / n* from the autocorrelation of their ranks, up to the first insignificant lag.

    `position` counts from 0 inside a key. Series under four values or of equal ranks have the factor 1. Correlations are sums of
    quarters and so exact in any order. Series of up to `short` values are gathered and taken in Arrow batches; only longer ones meet lag by lag.
    """
    known = values.where(F.col(value).isNotNull()).select(key, F.col(position).alias("i"), F.col(value).alias("v"))
    if not short:
        return _by_lags(known, key, alpha, lags)
    known = stage(known)
    long = stage(known.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > short).select(key))
    if not long.head(1):
        return _gathered(known, key, alpha)
    return _gathered(null_safe(known, long, [key], "left_anti"), key, alpha).unionByName(_by_lags(null_safe(known, long, [key], "left_semi"), key, alpha, lags))


def _gathered(known: DataFrame, key: str, alpha: float) -> DataFrame:
    """The factors of series that fit an array each."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v"))))
    arrays = known.groupBy(key).agg(F.count("*").alias("n"), ordered.alias("s")).select(key, "n", F.col("s.v").alias("v"))
    return arrays.select(key, "n", factor_udf(alpha)("v").alias("factor")).withColumn("effective_n", F.col("n") / F.col("factor"))


def _by_lags(known: DataFrame, key: str, alpha: float, lags: int) -> DataFrame:
    """The factors of series of any length (key, i, v)."""
    ranked = stage(average_rank(known, key, "v").select(key, "i", F.col("rank").alias("r")))
    sizes = ranked.groupBy(key).agg(F.count("*").alias("n"))
    centred = stage(null_safe(ranked, sizes, [key]).select(key, "i", "n", (F.col("r") - (F.col("n") + 1) / F.lit(2.0)).alias("c")))
    series = stage(centred.groupBy(key, "n").agg(F.sum(F.col("c") * F.col("c")).alias("power")))
    none = F.lit(0.0)
    frontier = stage(series.where("n > 3 AND power > 0").withColumn("total", none))
    done = series.where("NOT (n > 3 AND power > 0)").withColumn("total", none)
    first = 1
    z = quantile(alpha)
    while frontier.head(1):
        frontier = stage(_advanced(centred, frontier, key, first, lags, z))
        first += lags
        over = F.col("fired") | (F.col("n") - 3 < first)
        done = done.unionByName(frontier.where(over).drop("fired"))
        frontier = frontier.where(~over).drop("fired")
        lags *= 2
    n = F.col("n").cast("double")
    pairs = F.when(n > 2, n * (n - 1) * (n - 2))
    factor = F.when(F.col("total") == 0, 1.0).otherwise(F.greatest(1 + 2 / pairs * F.col("total"), F.lit(1e-6)))
    return done.select(key, "n", factor.alias("factor")).withColumn("effective_n", F.col("n") / F.col("factor"))


def _advanced(centred: DataFrame, frontier: DataFrame, key: str, first: int, lags: int, z: float) -> DataFrame:
    """The frontier after the lags from `first` on: (key, n, power, total, fired)."""
    open_ = null_safe(centred, frontier.select(key), [key], "left_semi")
    last = F.least(F.col("n") - 3, F.lit(first + lags - 1))
    ahead = open_.where(F.col("n") - 3 >= first).select(key, "i", "c", F.explode(F.sequence(F.lit(first).cast("long"), last)).alias("lag"))
    later = open_.select(F.col(key).alias("_key"), F.col("i").alias("_i"), F.col("c").alias("_c"))
    met = ahead.join(later, F.col(key).eqNullSafe(F.col("_key")) & (F.col("i") + F.col("lag") == F.col("_i")))
    sums = null_safe(met.groupBy(key, "lag").agg(F.sum(F.col("c") * F.col("_c")).alias("s")), frontier, [key])
    m = (F.col("n") - F.col("lag")).cast("double")
    judged = sums.withColumns({"rho": F.col("s") / F.col("power"), "m": m}).withColumn("stops", _inside(F.col("rho"), F.col("m"), z))
    stop = judged.groupBy(key).agg(F.min(F.when(F.col("stops"), F.col("lag"))).alias("stop"))
    term = F.col("m") * (F.col("m") - 1) * (F.col("m") - 2) * F.col("rho")
    counted = null_safe(judged, stop, [key]).groupBy(key, "n", "power", "total", "stop")
    found = counted.agg(F.sum(F.when(F.col("stop").isNull() | (F.col("lag") < F.col("stop")), term).otherwise(0.0)).alias("more"))
    return found.select(key, "n", "power", (F.col("total") + F.col("more")).alias("total"), F.col("stop").isNotNull().alias("fired"))
