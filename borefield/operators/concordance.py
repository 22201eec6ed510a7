"""Kendall's S by distributed inversion counting, for series of any length.

Values are replaced by their dense rank, and two values first differ at one bit of it, read from the highest. So at each bit,
among values that agree above it, a one before a zero is a falling pair and a zero before a one a rising pair, and every pair of
different values is counted at one bit. Ones that stand before are summed inside blocks of time, then over blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import kendall_sums
from ..staging import stage
from .scan import null_safe, positions

#: Readings of a block of time: what one task sums in order; readings of a series up to which it is one array.
BLOCK, SHORT = 1 << 16, 1 << 10
_WIDE = "decimal(38,0)"


def ranked(values: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, position, rank, distinct): places in time and dense ranks from 0, and how many different values the key has."""
    placed = positions(values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_value"), *order), [key], order)
    different = positions(values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_value")).distinct(), [key], ["_value"], "rank")
    counted = different.groupBy(key).agg(F.count("*").alias("distinct"))
    return null_safe(null_safe(placed, different, [key, "_value"]), counted, [key]).select(key, "position", "rank", "distinct")


def kendall_s(values: DataFrame, key: str, order: list[str], value: str = "value", block: int = BLOCK, short: int = SHORT) -> DataFrame:
    """(key, n, s): the number of pairs that rise in time less those that fall; equal values are neither.

    `order` is total inside a key. Null values take no part; a key of one value or of equal values has s = 0. Series of up to `short`
    values are gathered and compared in Arrow batches, longer ones, which are few, are counted by inversions.
    """
    known = values.where(F.col(value).isNotNull()).select(key, *order, F.col(value).alias("_value"))
    long = stage(known.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > short).select(key))
    if not long.head(1):
        return _gathered(known, key, order)
    rest = _gathered(null_safe(known, long, [key], "left_anti"), key, order)
    return rest.unionByName(_by_inversions(null_safe(values, long, [key], "left_semi"), key, order, value, block))


def _gathered(known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """S of series that fit an array each."""

    @F.pandas_udf("double")
    def sums(series: pd.Series) -> pd.Series:
        return pd.Series(kendall_sums([np.asarray(v, float) for v in series]))

    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col("_value").cast("double").alias("_value"))))
    arrays = known.groupBy(key).agg(F.count("*").alias("n"), pairs.alias("_s")).select(key, "n", F.col("_s._value").alias("_s"))
    return arrays.select(key, "n", sums("_s").alias("s"))


def _by_inversions(values: DataFrame, key: str, order: list[str], value: str, block: int) -> DataFrame:
    """S of series of any length."""
    ranks = stage(ranked(values, key, order, value))
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("distinct"))).cast("int") - 1, F.lit(0)))
    bits = ranks.where("distinct > 1").select(key, "position", "rank", F.explode(levels).alias("level"))
    one = F.expr("shiftright(rank, level) & 1").cast("int")
    above = F.expr("shiftright(rank, level + 1)")
    dealt = bits.select(key, "level", above.alias("above"), F.floor(F.col("position") / block).alias("block"), "position", one.alias("one"))
    inside = Window.partitionBy(key, "level", "above", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.withColumn("ones", F.coalesce(F.sum("one").over(inside), F.lit(0)))
    falls = F.sum(F.when(F.col("one") == 0, F.col("ones")).otherwise(0))
    blocks = before.groupBy(key, "level", "above", "block").agg(falls.alias("falls"), F.sum("one").alias("ones"), F.sum(1 - F.col("one")).alias("zeros"))
    earlier = Window.partitionBy(key, "level", "above").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.coalesce(F.sum("ones").over(earlier), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sums = carried.groupBy(key, "level", "above").agg(
        F.sum(F.col("falls").cast(_WIDE) + wide("zeros") * wide("carried")).alias("falls"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")
    )
    s = F.sum(wide("ones") * wide("zeros") - 2 * F.col("falls"))
    found = sums.groupBy(key).agg(s.cast("double").alias("s"))
    return null_safe(ranks.groupBy(key).agg(F.count("*").alias("n")), found, [key], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def tau_b(n: Column, s: Column, tied_pairs: Column) -> Column:
    """S over its largest value with the ties of the values; 0 where all values are equal."""
    pairs = n * (n - 1) / 2
    most = F.sqrt((pairs - tied_pairs) * pairs)
    return F.when(most > 0, s / most).otherwise(0.0)
