"""Helpers that the text operators share: reading, cutting lineage, Arrow batches, calibration."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage

_LIBC = ctypes.CDLL(None)
#: Bytes of text handled at once inside an Arrow task.
BATCH_BYTES = 4 << 20
#: A key is hot when it has over one in HOT of all rows, so there are fewer than HOT such keys.
HOT = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it again.

    Later stages then restart from files and not from executors that may be lost.
    """
    return stage(df)


def spread_join(rows: DataFrame, keys: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `keys` (each key once, `n` rows of `rows` or fewer have it) where one key may have a third of rows.

    Rows of hot keys, fewer than HOT of `total` rows, meet them by broadcast where they lie; only the rest are shuffled, so
    no task gets more than its share. Both sides are read more than once and must be stable (tables or checkpoints).
    """
    is_hot = F.col("n") > total // HOT
    hot, rest = keys.where(is_hot), keys.where(~is_hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot.drop("n")), key, how).unionByName(cold.join(rest.drop("n"), key, how))


def small_join(rows: DataFrame, keys: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Inner join that leaves `rows` where they lie if `keys`, which are counted, are at most `most`; else both are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, key)


def id_text(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty); other columns, whatever their names, are left out."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *keep,
    )


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called where a task begins: what other operators remember in this worker is forgotten, so workers hold one operator's memory."""
    for other in [x for x in _HELD if x != owner]:
        _HELD.pop(other)()
    _HELD[owner] = forget
    give_back()


def give_back() -> None:
    """What this process has freed goes back to the system, where its C library can do that."""
    gc.collect()
    trim()


def trim() -> None:
    """What this process has freed goes back without a search for what else could be freed: cheap enough for each batch."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives back what it has freed after each batch it yields and when its task ends, so that idle workers are small."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            trim()
        give_back()

    return tidied


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of about `limit` bytes of text; one long text is a run alone."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def learnable(key: Column, folds: int, held_out: int) -> Column:
    """True for rows a model may learn labels from; a null id is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of about `max_rows` labelled documents of the learning folds, chosen by a hash of the id.

    The bound keeps both the broadcast side and what a fit gathers independent of the corpus size. Labels
    that are null or given twice for a document with different values are not used.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(learnable(F.col("doc_id"), folds, fold) & F.col("y").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most")
        .drop("most")
    )
    n = usable.count()
    share = min(1.0, max_rows / max(n, 1))
    at = (F.xxhash64("doc_id", F.lit(label)) % 1_000_003 + 1_000_003) % 1_000_003
    chosen = usable.where(at < int(share * 1_000_003) + (share >= 1.0))
    return id_text(docs).join(F.broadcast(chosen), "doc_id")


def fit_platt(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one variable: (a, b) of 1 / (1 + exp(-(a + b x))), b >= 0.

    x holds bin centres, pos and neg the counts in each bin. Without both classes the score is the
    smoothed base rate.
    """
    p, q = float(pos.sum()), float(neg.sum())
    if not p or not q:
        return float(np.log((p + 0.5) / (q + 0.5))), 0.0
    theta, w = np.array([np.log(p / q), 0.0]), pos + neg
    design = np.stack([np.ones_like(x), x], 1)

    def loss(t: np.ndarray) -> float:
        z = design @ t
        return float((w * np.logaddexp(0, z) - pos * z).sum() + 0.5e-3 * t @ t)

    for _ in range(200):
        f = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (pos - w * f) - 1e-3 * theta
        hess = (design * (w * f * (1 - f))[:, None]).T @ design + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(theta)
        while loss(theta + step) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        theta = theta + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[1] >= 0 else (float(np.log(p / q)), 0.0)
