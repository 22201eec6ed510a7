"""Exact top-k inner products with multi-resolution segment bounds.

Over a segment of length m with means a, b and deviations s, t, the inner product is at most
m (a b + s t); equally the squared distance is at least m ((a - b)^2 + (s - t)^2). Coarse segments discard most
candidates of a query, finer ones most of the rest, and exact products are computed for the survivors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of candidates and of queries that meet in one task (on average), and segment counts, coarse to fine.
CANDIDATES, QUERIES, LEVELS, CHUNK = 32_768, 2_048, (4, 16), 2_048


def integer_vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): floor(256 x) of each component; vectors null, or with a null or non-finite component, are left out."""
    x = F.transform(F.col(column), lambda c: F.floor(c.cast("double") * 256).cast("double"))
    finite = F.forall(F.col(column), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))


def summaries(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows whose products bound the vectors' products: root-weighted means and deviations of each segment."""
    out = []
    for cut in np.array_split(np.arange(x.shape[1]), min(parts, max(x.shape[1], 1))):
        if len(cut):
            root = math.sqrt(len(cut))
            out += [x[:, cut].mean(1) * root, x[:, cut].std(1) * root]
    return np.stack(out, 1) if out else np.zeros((len(x), 1))


def best_in_block(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, vec_id, score) of each query's k best of the block, ties to smaller ids, its own id left out.

    `least` are scores that k candidates of a query are known to reach, so lower ones aren't looked for. A score that
    leaves 64 bits is an OverflowError, never a wrong number.
    """
    order = np.argsort(ids, kind="stable")
    v, ids = v[order], ids[order]
    best = np.full((len(q), k), -np.inf)
    if least is not None:
        best[:] = (np.nextafter(least, -np.inf) - 1e-15 * np.abs(least))[:, None]
    if max(np.abs(q).max(initial=0.0), np.abs(v).max(initial=0.0)) >= 2.0**63:
        raise OverflowError("a component leaves 64 bits")
    kept: list[list[tuple[float, int]]] = [[] for _ in q]
    exact = lambda a: float(np.abs(a).max(initial=0.0))
    small = exact(q) * exact(v) * max(v.shape[1], 1) < 2**52  # doubles hold every sum exactly
    coarse = [(summaries(q, p), summaries(v, p)) for p in LEVELS if p < v.shape[1]]
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max(initial=0.0) + 1e-6
    for at in range(0, len(v), CHUNK):
        end = min(at + CHUNK, len(v))
        floor = best[:, -1]
        live = np.ones((len(q), end - at), bool)
        if at or least is not None:
            for level, (a, b) in enumerate(coarse):
                if level == 0:
                    live = a @ b[at:end].T + slack[:, None] > floor[:, None]
                elif live.mean() < 0.2:
                    i, j = np.nonzero(live)
                    live[i, j] = (a[i] * b[at + j]).sum(1) + slack[i] > floor[i]
                else:
                    live &= a @ b[at:end].T + slack[:, None] > floor[:, None]
        live &= q_ids[:, None] != ids[None, at:end]
        rows, columns = np.nonzero(live)
        if not len(rows):
            continue
        if not small:
            about = np.einsum("ij,ij->i", q[rows], v[at + columns])
            if (np.abs(about) >= 2.0**63 * (1 - 1e-9)).any():
                raise OverflowError("an inner product leaves 64 bits")
            with np.errstate(over="ignore"):  # sums modulo 2**64 are right where the whole sum fits
                scores = (q[rows].astype(np.int64) * v[at + columns].astype(np.int64)).sum(1)
        elif len(rows) > 0.1 * live.size:
            scores = (q @ v[at:end].T)[rows, columns]
        else:
            scores = np.einsum("ij,ij->i", q[rows], v[at + columns])
        over = scores > floor[rows]  # ids ascend, so a tie with the k-th never wins
        rows, columns, scores = rows[over], columns[over], scores[over]
        starts = np.searchsorted(rows, np.unique(rows))
        for s, e in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            i = rows[s]
            top = np.lexsort((columns[s:e], -scores[s:e]))[:k]
            merged = kept[i] + [(scores[s + t], int(ids[at + columns[s + t]])) for t in top]
            merged.sort(key=lambda p: (-p[0], p[1]))
            kept[i] = merged[:k]
            if len(kept[i]) == k:
                best[i] = [float(p[0]) if small else float(p[0]) - 1e-15 * abs(float(p[0])) for p in kept[i]]
    return [(int(q_ids[i]), vec_id, int(score)) for i, found in enumerate(kept) for score, vec_id in found]


def exact_top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` holds, against all other rows.

    `vectors` is (vec_id, v array<double> of whole numbers). Rows with the query's vec_id are its own; repeated
    ids among candidates count each. Vectors of another length than the query's don't take part for it. Query groups and
    candidate groups meet in a grid of tasks of bounded size, each row copied to one row or column of the grid. Before that, every query
    meets one block of candidates alone, and its k-th best score there bounds what is looked for everywhere.
    """
    n, m = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    spark = vectors.sparkSession
    across = max(math.ceil(n / CANDIDATES), min(int(spark.sparkContext.defaultParallelism), math.ceil(n / CHUNK)), 1)
    down = max(math.ceil(m / QUERIES), 1)
    sized = vectors.withColumn("dim", F.size("v"))
    grid = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    spot = lambda count: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
    queries = sized.where(is_query).select("dim", "vec_id", "v", spot(down).alias("h"))
    fresh = [F.col(c).alias(c) for c in ("dim", "vec_id", "v")]  # told apart from the queries' columns
    spread = sized.select(*fresh, spot(across).alias("g"), F.explode(grid(down)).alias("h"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, len(flat) // t.num_rows), t.column("vec_id").to_numpy()

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            least = queries.column("least").to_numpy() if "least" in queries.column_names else None
            found = best_in_block(*matrix(queries), *matrix(candidates), k, least)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    keys, schema = ("dim", "g", "h"), "query_id long, vec_id long, score long"
    first_block = F.pmod(F.xxhash64("v", "vec_id"), F.lit(max(1, math.ceil(n / CHUNK)))) == 0
    near = queries.withColumn("g", F.lit(0)).groupBy(*keys).cogroup(spread.where(first_block).withColumn("g", F.lit(0)).groupBy(*keys)).applyInArrow(meet, schema)
    reached = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
    known = queries.join(reached.drop("n"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    left = known.select("dim", "vec_id", "v", "least", "h", F.explode(grid(across)).alias("g"))
    pairs = left.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
