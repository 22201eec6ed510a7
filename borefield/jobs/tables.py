"""Loading and publishing the trusted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import GRID_SRID, require_within_zone
from ..operators.levels import datum_status, nan_to_null, require_columns
from ..operators.readings import merge_readings
from ..operators.sufficiency import Thresholds
from ..operators.trends import bore_trends
from ..sources.layers import file_store, publish_version

#: Readings lie in a folder a month, with Bloom filters of their bores; up to so many bores are looked up in them.
MONTH, FEW_BORES = "month", 10
_BLOOM = {"parquet.bloom.filter.enabled#bore_id": "true"}


def bore_table(raw: DataFrame, source_file: str, source_crs: str) -> DataFrame:
    """Raw bores (bore_id, x, y, collar_rl_m_ahd, ...) as the trusted table, with datum flag and provenance."""
    require_columns(raw, "bore_id", "x", "y", "collar_rl_m_ahd")
    collar = nan_to_null(F.col("collar_rl_m_ahd").cast("double"))
    source = F.col("collar_rl_source") if "collar_rl_source" in raw.columns else F.lit(None)
    return raw.select(
        "bore_id",
        F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"),
        F.lit(GRID_SRID).alias("srid"),
        collar.alias("collar_rl_m_ahd"),
        source.cast("string").alias("collar_rl_source"),
        datum_status(collar).alias("datum_status"),
        F.lit(source_file).alias("source_file"),
        F.lit(source_crs).alias("source_crs"),
    )


def load_bores(raw: DataFrame, path: str, source_file: str, source_crs: str, validate_zone: bool = True) -> None:
    """Write the bore table; points must land in the zone unless told not to check. loaded_at is set on writing."""
    table = bore_table(raw, source_file, source_crs)
    if validate_zone:
        require_within_zone(table, source_file)
    table.withColumn("loaded_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def append_readings(spark: SparkSession, path: str, batch: DataFrame, order: list[str], source_file: str | None = None) -> None:
    """Append a batch's new readings to the table at `path`, with where they are from; running it again adds nothing.

    The table is partitioned by month of observation, so a batch meets only the months it has.     Without `source_file`, and where the batch has none, it is the file a row was read from. loaded_at is set on writing.
    """
    require_columns(batch, "bore_id", "observed_at")
    if source_file is not None:
        batch = batch.withColumn("source_file", F.lit(source_file))
    elif "source_file" not in batch.columns:
        batch = batch.withColumn("source_file", F.coalesce(F.nullif(F.input_file_name(), F.lit("")), F.lit("unnamed")))
    merge_readings(stored_keys(spark, path, batch), batch, order).withColumns({"loaded_at": F.current_timestamp(), MONTH: _month()}).write.options(**_BLOOM).partitionBy(MONTH).mode("append").parquet(path)


def _month() -> Column:
    return F.year("observed_at") * 100 + F.month("observed_at")


def stored_keys(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """(bore_id, observed_at) stored at `path` that `batch` may hold too; none where there is no table yet.

    Only the batch's months are read, and where it has few bores, only row groups whose Bloom filter may have them.
    """
    fs, at = file_store(spark, path)
    if not fs.exists(at(path)):
        return batch.limit(0).select("bore_id", "observed_at")
    months = [r.m for r in batch.select(_month().alias("m")).where("m IS NOT NULL").distinct().collect()]  # twelve a year
    bores = [r.bore_id for r in batch.select("bore_id").distinct().limit(FEW_BORES + 1).collect()]
    stored = spark.read.parquet(path).where(F.col(MONTH).isin(months))
    return (stored if len(bores) > FEW_BORES else stored.where(F.col("bore_id").isin(bores))).select("bore_id", "observed_at")


def write_trends(readings: DataFrame, bores: DataFrame, path: str, thresholds: Thresholds | None = None) -> None:
    bore_trends(readings, bores, thresholds).withColumn("computed_at", F.current_timestamp()).write.mode("overwrite").parquet(path)


def trend_layer(trends: DataFrame, bores: DataFrame) -> DataFrame:
    """Trends with their bore's point, datum flag and collar: what a map shows."""
    return trends.join(bores.select("bore_id", "x", "y", "srid", "datum_status", "collar_rl_m_ahd"), "bore_id")


def publish(path: str, trends: DataFrame, bores: DataFrame, others: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """A new version of the map's layers; readers see the one before until this one is whole."""
    return publish_version(path, {"bore_trend": trend_layer(trends, bores)} | (others or {}))
