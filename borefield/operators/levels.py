"""Water levels from collar heights, without losing a reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN, MISSING = "collar_rl_known", "collar_rl_missing"
BASES = ("head_m_ahd", "depth_to_water_m")


def require_columns(df: DataFrame, *names: str) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise KeyError(f"no column {', '.join(lost)}")


def require_unique(df: DataFrame, *key: str) -> None:
    """Raise if a key is there twice: a join would then multiply rows."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} isn't unique: {twice[0]}")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def datum_status(collar: Column) -> Column:
    return F.when(collar.isNull() | F.isnan(collar), MISSING).otherwise(KNOWN)


def derive_levels(readings: DataFrame, bores: DataFrame, check: bool = True) -> DataFrame:
    """Readings with collar_rl_m_ahd, level_m_ahd (collar less depth) and datum_status.

    A left join: readings without a bore or collar stay, with null levels. Bores must be unique by bore_id
    (checked unless told not to). The optimizer broadcasts the bores only when their size is known to be small.
    """
    require_columns(readings, "bore_id", "depth_to_water_m")
    require_columns(bores, "bore_id", "collar_rl_m_ahd")
    if check:
        require_unique(bores.where("bore_id IS NOT NULL"), "bore_id")
    collar = bores.select("bore_id", nan_to_null(F.col("collar_rl_m_ahd")).alias("collar_rl_m_ahd"))
    joined = readings.drop("collar_rl_m_ahd", "level_m_ahd", "datum_status").join(collar, "bore_id", "left")
    return joined.withColumns(
        {"level_m_ahd": F.col("collar_rl_m_ahd") - nan_to_null(F.col("depth_to_water_m")), "datum_status": datum_status(F.col("collar_rl_m_ahd"))}
    )


def datum_summary(levels: DataFrame) -> DataFrame:
    return levels.agg(
        F.count("*").alias("n_readings"),
        F.count("level_m_ahd").alias("n_with_level"),
        F.count(F.when(F.col("datum_status") == MISSING, 1)).alias("n_without_collar"),
    )


def choose_basis(collar: Column) -> Column:
    """Decided by bore: the head where the collar is known, else the depth."""
    return F.when(datum_status(collar) == KNOWN, BASES[0]).otherwise(BASES[1])


def basis_values(levels: DataFrame) -> DataFrame:
    """(bore_id, observed_at, basis, value): what a bore's trend is tested on."""
    basis = choose_basis(F.col("collar_rl_m_ahd"))
    value = F.when(basis == BASES[0], F.col("level_m_ahd")).otherwise(nan_to_null(F.col("depth_to_water_m")))
    return levels.select("bore_id", "observed_at", basis.alias("basis"), value.alias("value"))
