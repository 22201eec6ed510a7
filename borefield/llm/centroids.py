"""Centroid clustering by partial-distance search, on integers.

Each round assigns every vector where it lies and sends one row of sums a cluster and task; new centroids are exact integer
means. A vector's squared distances are accumulated over the dimensions of highest variance first, and a centroid is given
up once its sum is strictly above the best whole distance; what survives finishes all dimensions. So ties stay, and the
smaller number wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest absolute component, so that squared distances stay within 64 bits.
LARGEST = 1 << 27
#: Dimensions added at once; pairs of a vector and a centroid held at once.
_BLOCK, _PAIRS = 8, 1 << 20


def _whole(batches):
    """(vec_id, integers) of vectors with exactly DIMS finite components."""
    for batch in batches:
        lists = batch.column("embedding")
        batch = batch.filter(pc.equal(pc.list_value_length(lists), DIMS).fill_null(False))
        flat = pc.list_flatten(batch.column("embedding")).cast(pa.float64())
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        kept = np.isfinite(x).all(axis=1)
        whole = np.floor(SCALE * x[kept])
        if len(whole) and np.abs(whole).max() > LARGEST:
            raise OverflowError(f"a component beyond {LARGEST} has squared distances beyond 64 bits")
        rows = pa.FixedSizeListArray.from_arrays(pa.array(whole.astype(np.int32).ravel()), DIMS).cast(pa.list_(pa.int32()))
        yield pa.record_batch([batch.column("vec_id").filter(pa.array(kept)), rows], ["vec_id", "v"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the smaller number of equal ones; `order` of the dimensions."""
    step = max(1, _PAIRS // len(centroids))
    parts = [_nearest(x[i : i + step][:, order], centroids[:, order]) for i in range(0, len(x), step)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(x))
    partial = ((x[:, None, :_BLOCK] - centroids[None, :, :_BLOCK]) ** 2).sum(2)
    first = partial.argmin(1)
    best = ((x - centroids[first]) ** 2).sum(1)  # the most promising centroid is finished at once
    alive = partial <= best[:, None]
    alive[at, first] = False
    rows, own = np.nonzero(alive)
    sums = partial[rows, own]
    for d in range(_BLOCK, x.shape[1], _BLOCK):
        sums = sums + ((x[rows, d : d + _BLOCK] - centroids[own, d : d + _BLOCK]) ** 2).sum(1)
        stays = sums <= best[rows]
        rows, own, sums = rows[stays], own[stays], sums[stays]
    rows, own, sums = np.append(rows, at), np.append(own, first), np.append(sums, best)
    ranked = np.lexsort((own, sums, rows))
    leads = ranked[np.searchsorted(rows[ranked], at)]
    return own[leads], sums[leads]


def _assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            own, distance = nearest(_matrix(batch), centroids, order)
            yield pa.record_batch([batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _means(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact means; an empty cluster keeps its centroid."""
    k = len(centroids)

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            x = _matrix(batch)
            own = nearest(x, centroids, order)[0]
            by = np.argsort(own, kind="stable")
            found, starts = np.unique(own[by], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(x[by], starts)
            counts += np.bincount(own, minlength=k)
        used = np.flatnonzero(counts)
        if len(used):
            rows = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), DIMS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used]), rows], ["cluster", "n", "sums"])

    partial = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[d]) for d in range(DIMS))).alias("sums"))
    moved = centroids.copy()
    for r in whole.collect():  # a row a cluster
        moved[r.cluster] = [s // r.n for s in r.sums]
    return moved


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of DIMS finite components.

    Centroids begin as the k vectors of the least sha256 of `seed:vec_id`; fewer vectors make fewer clusters. Vectors that are null,
    of another length or with a null or non-finite component take no part; repeated rows count each; a null id hashes as an
    empty one; equal distances go to the smaller number; an empty table gives an empty one. Components beyond LARGEST
    raise an error, as distances would leave 64 bits. Only centroids and sums by cluster reach the driver.
    """
    vectors = materialize(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_whole, "vec_id long, v array<int>"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.v for r in vectors.select("v").orderBy(rank, "v").limit(k).collect()], np.int64).reshape(-1, DIMS)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    spread = vectors.agg(*(F.var_pop(F.col("v")[d]) for d in range(DIMS))).first()
    order = np.argsort(-np.array(spread, float), kind="stable")
    for _ in range(rounds):
        centroids = _means(vectors, centroids, order)
    assigned = materialize(_assigned(vectors, centroids, order))
    by_cluster = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    rows = [(c, s, sum(by_cluster.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in by_cluster.items()]
    totals = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [
        f"""vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, v AS c FROM vectors ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM vectors CROSS JOIN c{i})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY d) AS c FROM (
    SELECT cluster, d, CAST(sum(v[d]) AS BIGINT) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {DIMS + 1}) t(d) GROUP BY cluster, d) GROUP BY cluster) m USING (cluster))"""
            )
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} USING (cluster)"""
    )


SQL = _sql()
