"""What lies in a folder, by kind of file, with sidecars folded into their main file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import excluded_theme, human_bytes

# File name endings of each kind, and the sidecars of a .shp file.
KINDS = {
    "spatial": [".shp", ".gpkg", ".geojson", ".json", ".kml", ".kmz", ".gml", ".gdb", ".tab"],
    "tabular": [".csv", ".tsv", ".txt", ".psv"],
    "excel": [".xlsx", ".xls", ".xlsm"],
    "archive": [".zip", ".7z", ".tar", ".gz", ".tgz"],
}
SIDECARS = [".shx", ".dbf", ".prj", ".sbn", ".sbx", ".cpg", ".qix", ".qpj", ".xml"]


def kind_of(suffix: Column) -> Column:
    return F.coalesce(*(F.when(suffix.isin(endings), kind) for kind, endings in KINDS.items()), F.lit("unrecognised"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under `root`; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def inventory(files: DataFrame) -> DataFrame:
    """(path, stem, suffix, kind, size, excluded_theme) for (path, length), sidecars of a .shp left out.

    Files of an excluded theme are listed, for a later step not to open.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.withColumn("suffix", F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)))
    parts = parts.withColumn("base", F.expr("left(path, length(path) - length(suffix))"))
    main = parts.where(F.col("suffix") == ".shp").select("base", F.lit(True).alias("sidecar")).distinct()
    side = parts.withColumn("sidecar", F.col("suffix").isin(SIDECARS))
    kept = side.join(main, ["base", "sidecar"], "left_anti")
    stem = F.element_at(F.split("base", "/"), -1)
    return kept.select("path", stem.alias("stem"), "suffix", kind_of(F.col("suffix")).alias("kind"), human_bytes(F.col("length")).alias("size"), excluded_theme(stem).alias("excluded_theme"))
