"""Prefix scans: running sums inside a key whose rows many tasks hold.

Rows are sorted by range, so a large key lies in several parts. Every part sums its own rows; what the parts before it
hold of the same key, a row a part and key, is added. No task sees more than its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

_PART, _AT, _OWN, _BEFORE = "_part", "_at", "_own", "_before"


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on `keys` in which nulls meet; `right` has no other column of `left`."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(renamed, on, how).drop(*(f"_of_{k}" for k in keys))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, weight: Column | None = None) -> DataFrame:
    """`rows` with `name`: the sum of `weight` (a whole number, 1 if not given) over rows of the same keys that stand before in `order`.

    `order` should be total inside a key; rows that tie stand in any order. Nulls are a key and stand first.
    """
    by = [*keys, *order]
    local = F.monotonically_increasing_id()
    sorted_ = rows.withColumn(_OWN, F.lit(1) if weight is None else weight).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(sorted_.withColumns({_PART: F.shiftright(local, 33), _AT: local}))
    parts = placed.groupBy(_PART, *keys).agg(F.sum(_OWN).alias(_OWN))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(_PART, *keys, F.coalesce(F.sum(_OWN).over(earlier), F.lit(0)).alias(_BEFORE))
    inside = Window.partitionBy(_PART, *keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(_OWN).over(inside), F.lit(0)))
    return null_safe(summed, carried, [_PART, *keys]).withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_PART, _AT, _OWN, _BEFORE)


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """`rows` with their place, from 0, inside their key."""
    return running_sum(rows, keys, order, name)
