"""Merging readings: the first of a key wins, and what is stored stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("bore_id", "observed_at")


def first_wins(readings: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """The first row of each key by `order`, which must be total for a result that is always the same.

    A minimum of the row as a struct: partial sums go before the shuffle, so a key that a third of rows share
    costs one row a task. Rows with a null in the key can't be stored and are left out (see checks).
    """
    rest = [c for c in readings.columns if c not in key and c not in order]
    whole = readings.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))
    first = whole.groupBy(*key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("first"))
    return first.select(*key, *(F.col(f"first.{c}").alias(c) for c in (*order, *rest))).select(readings.columns)


def merge_readings(stored: DataFrame, batch: DataFrame, order: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """The rows of `batch` to append: the first of each key whose key isn't stored."""
    return first_wins(batch, order, key).join(stored.select(*key), list(key), "left_anti")


def delete_bores(gone: DataFrame, bores: DataFrame, *dependents: DataFrame) -> list[DataFrame]:
    """Bores without those in `gone`, and each dependent table with only the rows of bores that stay."""
    stay = bores.join(gone.select("bore_id"), "bore_id", "left_anti")
    return [stay, *(d.join(stay.select("bore_id"), "bore_id", "left_semi") for d in dependents)]
