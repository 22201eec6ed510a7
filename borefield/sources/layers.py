"""Map layers as Parquet datasets, checked before and after they are written."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import GRID_SRID, CrsError, require_grid_srid
from ..functions.naming import require_in_scope


#: The file that names the version in use.
POINTER = "CURRENT"


class LayerError(ValueError):
    """Which layer is meant isn't clear, or there is none."""


def select_layer(df: DataFrame, layer: str | None = None) -> DataFrame:
    """The named layer, or the only one; several and none named raise, as does a name that no row has."""
    if layer is not None:
        found = df.where(F.col("layer") == layer)
        if not found.head(1):
            raise LayerError(f"no layer {layer!r}")
        return found
    names = [r.layer for r in df.select("layer").distinct().orderBy("layer").limit(3).collect()]
    if len(names) != 1:
        raise LayerError(f"{len(names)} or more layers ({names}) and none named")
    return df.where(F.col("layer") == names[0])


def _require_layers(layers: dict[str, DataFrame]) -> SparkSession:
    """Raise for no layers, a name out of scope, or a layer that isn't on the grid; the layers' session."""
    if not layers:
        raise LayerError("no layers to write")
    spark = next(iter(layers.values())).sparkSession
    require_in_scope(spark.createDataFrame([(n,) for n in layers], "layer string"))
    for name, df in layers.items():
        require_grid_srid(df, name)
    return spark


def publish_version(path: str, layers: dict[str, DataFrame]) -> dict[str, int]:
    """Write `layers` as a new version under `path`, verify it, then let the pointer name it: one small file, replaced at once.

    Whoever reads sees one whole version at any time: until the pointer is replaced the one before, which stays for those who have
    opened it; what is older, or was left by a job that died, is removed.
    """
    spark, root, version = _require_layers(layers), path.rstrip("/"), f"v-{uuid.uuid4().hex}"
    for name, df in layers.items():
        df.write.parquet(f"{root}/{version}/{name}")
    found = verify_layers(spark, f"{root}/{version}", list(layers))
    before = current_version(spark, root)
    _point(spark, root, version)
    fs, at = file_store(spark, root)
    for s in fs.listStatus(at(root)):
        if s.isDirectory() and s.getPath().getName() not in (version, before):
            fs.delete(s.getPath(), True)
    return found


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Replace the pointer by one that names `version`, by a rename, which readers see before or after and never between."""
    fs, at = file_store(spark, root)
    fresh = at(f"{root}/{POINTER}-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(root).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(at(f"{root}/{POINTER}")), options)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer under `path` names; None where nothing was published."""
    root = path.rstrip("/")
    fs, at = file_store(spark, root)
    return spark.read.text(f"{root}/{POINTER}").first()[0] if fs.exists(at(f"{root}/{POINTER}")) else None


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The layers of the current version, all of the same one; raises where there is none."""
    version = current_version(spark, path)
    if version is None:
        raise LayerError(f"nothing is published at {path}")
    root = f"{path.rstrip('/')}/{version}"
    fs, at = file_store(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(root)) if s.isDirectory())
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def write_layers(path: str, layers: dict[str, DataFrame]) -> dict[str, int]:
    """Replace what `path` holds by `layers`: names and SRIDs of all are checked before any is written, then read back.

    All are written and verified beside the target and then take its place, so the target is the old one or the new one as a whole.
    """
    spark = _require_layers(layers)
    target = path.rstrip("/")
    staged, old = f"{target}-new-{uuid.uuid4().hex}", f"{target}-old-{uuid.uuid4().hex}"
    fs, at = file_store(spark, target)
    try:
        for name, df in layers.items():
            df.write.parquet(f"{staged}/{name}")
        verify_layers(spark, staged, list(layers))
        had = fs.exists(at(target))
        if had and not fs.rename(at(target), at(old)):
            raise OSError(f"{target} can't be moved")
        if not fs.rename(at(staged), at(target)):
            if had:
                fs.rename(at(old), at(target))
            raise OSError(f"{staged} can't take the place of {target}")
        fs.delete(at(old), True)
    finally:
        fs.delete(at(staged), True)
    return verify_layers(spark, target)


def file_store(spark: SparkSession, path: str):
    """The store that holds `path`, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def stored_layer_srids(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, srids, n_rows) of all layers; partial sets of a few codes go before the shuffle."""
    parts = [df.select(F.lit(n).alias("layer"), F.col("srid").cast("int").alias("srid")) for n, df in layers.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("layer").agg(F.array_sort(F.collect_set(F.coalesce("srid", F.lit(-1)))).alias("srids"), F.count("*").alias("n_rows"))


def verify_layers(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, int]:
    """{layer: SRID} as stored, of `names` or of all layers under `path`; raises where one isn't on the grid. An empty layer is on it."""
    if names is None:
        fs, at = file_store(spark, path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory())
    found = {r.layer: r.srids for r in stored_layer_srids({n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}).collect()}
    if wrong := {n: s for n, s in found.items() if s != [GRID_SRID]}:
        raise CrsError(f"stored layers aren't on EPSG {GRID_SRID}: {wrong}")
    return dict.fromkeys(names, GRID_SRID)
