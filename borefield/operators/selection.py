"""Exact medians of many groups at once, none of which has to fit a task.

Every group has its own bracket of values that holds its middle, and all brackets are narrowed together: a round sketches
each group's values inside its bracket, cuts them there, and counts between the cuts. A group is done once few rows or one value
are left, and only those are gathered. Rows themselves aren't shuffled until then; rounds grow with the logarithm of the largest group.
Groups of few rows, mostly all, are sorted at once and meet no brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .scan import null_safe

#: Rows that are gathered for a group; cuts of a round, closest round the middle, and how fine its sketch is.
FEW, CUTS, FINE = 1 << 14, (0.0, 0.1, 0.25, 0.4, 0.49, 0.4985, 0.5015, 0.51, 0.6, 0.75, 0.9, 1.0), 2000


def sorted_medians(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, n, median) by one sort of `rows` by group and value: no group's values are held in memory, but a group is one task's."""
    order = Window.partitionBy(*keys).orderBy(value)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = {"_at": F.row_number().over(order), "_next": F.lead(value).over(order), "n": F.count("*").over(whole)}
    placed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)).withColumns(places)
    upper = F.when(F.col("n") % 2 == 1, F.col(value)).otherwise(F.col("_next"))
    return placed.where(F.col("_at") == F.floor((F.col("n") + 1) / 2)).select(*keys, "n", ((F.col(value) + upper) / 2).alias("median"))


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str = "value", weight: Column | None = None, few: int = FEW) -> DataFrame:
    """(keys, n, lower, upper, median): of each group's values that aren't null, their number and the middle two; the median is their mean.

    A row counts `weight` times (a whole number, once if not given). Groups without values are left out; nulls are a group. `rows`
    is read several times and must be stable (a table or a stage).
    """
    once = F.lit(1).cast("long") if weight is None else weight.cast("long")
    values = rows.select(*keys, F.col(value).cast("double").alias("x"), once.alias("w")).where("x IS NOT NULL")
    start = values.groupBy(*keys).agg(F.sum("w").alias("n"), F.count("*").alias("size"), F.min("x").alias("low"), F.max("x").alias("high"))
    crowded = start.where(F.col("size") > few)  # few groups: no more than rows / few
    brackets = stage(crowded.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("below"), _is_open(F.col("size"), few).alias("open")))
    if not brackets.head(1):
        return _middles(values.select(*keys, "x", "w", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("below")), keys)
    groups, done = brackets.select(*keys), brackets.where("NOT open")
    small = null_safe(values, F.broadcast(groups), keys, "left_anti")
    while (open_ := brackets.where("open")).head(1):
        brackets = stage(_narrowed(null_safe(values, open_.drop("open"), keys).where("x BETWEEN low AND high"), keys, few))
        done = done.unionByName(brackets.where("NOT open"))
    near = null_safe(values, done.drop("open"), keys).where("x BETWEEN low AND high").groupBy(*keys, "n", "below", "x").agg(F.sum("w").alias("w"))
    whole = small.select(*keys, "x", "w", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("below"))
    return _middles(whole.unionByName(near.select(*whole.columns)), keys)


def _middles(near: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, lower, upper, median) of `near` (keys, x, w, n, below): a group's values round its middle, or all of them where n is null."""
    order = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("n", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    summed = near.withColumns({"_total": total, "_upto": F.col("below") + F.sum("w").over(order)}).drop("n").withColumnRenamed("_total", "n")
    following = F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))
    # The row at which the sum passes the lower middle; the upper one is its own value or the next.
    placed = summed.withColumn("_next", following).where((F.col("_upto") > _first()) & (F.col("_upto") - F.col("w") <= _first()))
    upper = F.when(F.col("_upto") > _last(), F.col("x")).otherwise(F.col("_next"))
    return placed.select(*keys, "n", F.col("x").alias("lower"), upper.alias("upper")).withColumn("median", (F.col("lower") + F.col("upper")) / 2)


def _first() -> Column:
    return F.floor((F.col("n") - 1) / 2)


def _last() -> Column:
    return F.floor(F.col("n") / 2)


def _is_open(size: Column, few: int) -> Column:
    return (size > few) & (F.col("low") < F.col("high"))


def _narrowed(known: DataFrame, keys: Sequence[str], few: int) -> DataFrame:
    """Of `known` (keys, n, low, high, below, x, w) the brackets between cuts that hold the middle. Cuts only decide how fast it goes."""
    cuts = stage(known.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", list(CUTS), FINE)).alias("cuts")))
    # Odd buckets hold one value, a cut; even ones what lies between two cuts.
    each = [F.get("cuts", F.lit(i)) for i in range(len(CUTS))]
    bucket = sum((F.coalesce(passed.cast("int"), F.lit(0)) for c in each for passed in (c < F.col("x"), c <= F.col("x"))), F.lit(0))
    parts = null_safe(known, cuts, keys).groupBy(*keys, "n", "below", bucket.alias("bucket")).agg(
        F.sum("w").alias("w"), F.count("*").alias("size"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    upto = F.col("below") + F.sum("w").over(Window.partitionBy(*keys).orderBy("bucket"))
    held = parts.withColumn("upto", upto).where((F.col("upto") > _first()) & (F.col("upto") - F.col("w") <= _last()))
    bracket = held.groupBy(*keys, "n").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("upto") - F.col("w")).alias("below"), F.sum("size").alias("size"), F.max(F.col("low") < F.col("high")).alias("several"))
    # Two middle values may be there any number of times: buckets of one value each are narrow enough.
    return bracket.select(*keys, "n", "low", "high", "below", (_is_open(F.col("size"), few) & F.col("several")).alias("open"))
