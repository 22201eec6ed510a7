"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, fit_platt, held_out, id_text, labelled_sample, materialize, table

FOLDS, HELD_OUT, THRESHOLD, MAX_ROWS = 3, 1, 0.5, 60_000
NAMES = (
    "log_words", "log_word_length", "upper", "digit", "stop", "symbol", "bar", "bang",
    "distinct", "same_as_before", "top_word", "initial_upper", "log_line_words", "spread",
)
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _k, _chars in ((4, b".,;:"), (5, b"#$%&*@^~=<>\\_"), (6, b"|"), (7, b"!?"), (8, b" \t\r\n\x0b\x0c")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 2


def _logit(x: float) -> float:
    return float(np.log((x + 0.005) / (1.005 - x)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of sizes, logits of shares. No words: those of zero counts."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    solid = max(kinds.sum() - kinds[8], 1.0)
    lengths = np.fromiter(map(len, words), np.float64, n)
    codes = np.fromiter(map(hash, words), np.int64, n)
    values, counts = np.unique(codes, return_counts=True)
    m = max(n, 1)
    upper = sum(1 for w in words if 65 <= w[0] <= 90)
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean() if n else 0.0)),
        _logit(kinds[1] / max(kinds[1] + kinds[2], 1.0)),
        _logit(kinds[3] / solid),
        _logit(kinds[4] / solid),
        _logit(kinds[5] / solid),
        _logit(kinds[6] / solid),
        _logit(kinds[7] / solid),
        _logit(len(values) / m),
        _logit(float((codes[1:] == codes[:-1]).sum()) / m),
        _logit(float(counts.max()) / m if n else 0.0),
        _logit(upper / m),
        float(np.log1p(n / (raw.count(b"\n") + 1))),
        float(np.log1p(lengths.std() if n else 0.0)),
    ]


@dataclass
class QuadraticModel:
    """Class means and cached inverse Cholesky factors of the shrunken covariances; a logistic map of the difference."""

    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    logdets: list[float] = field(default_factory=list)
    platt: tuple[float, float] = (0.0, 0.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0, squashed."""
        if not self.means:
            return np.zeros(len(x))
        dens = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.factors, self.logdets, strict=True)]
        d = dens[1] - dens[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a + b * self.difference(x), -30, 30)))


def shrink(own: np.ndarray, pooled: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    mixed = (1 - to_pooled) * own + to_pooled * pooled
    return (1 - to_diagonal) * mixed + to_diagonal * np.diag(np.diag(mixed)) + ridge * np.eye(len(own))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(NAMES)) if len(x) else np.zeros((0, len(NAMES)))


def _statistics(batches):
    kind = pa.list_(pa.float64())
    for batch in batches:
        for part in by_bytes(batch):
            x = [statistics(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("y"), pa.array(x, kind)], ["y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QuadraticModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold; moments are summed on Spark, by class.

    Without rows of both classes the model gives one score to all.
    """
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, max_rows)
    x = materialize(sample.select("text", "y").mapInArrow(_statistics, "y int, x array<double>"))
    d = len(NAMES)
    at = [F.col("x")[i] for i in range(d)]
    rows = x.groupBy("y").agg(F.count("*"), *(F.avg(a) for a in at)).collect()
    means = {r[0]: np.array(r[2:]) for r in rows}
    n = {r[0]: r[1] for r in rows}
    model = QuadraticModel()
    if set(n) != {0, 1}:
        model.platt = fit_platt(np.zeros(1), np.array([n.get(1, 0)]), np.array([n.get(0, 0)]))
        return model

    def moments(batches):
        for batch in batches:
            own, y = _matrix(batch), batch.column("y").to_numpy()
            out = [(own[y == k] - means[k]).T @ (own[y == k] - means[k]) for k in (0, 1)]
            yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([m.ravel() for m in out], pa.list_(pa.float64()))], ["y", "m"])

    summed = x.mapInArrow(moments, "y int, m array<double>").select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col")).collect()
    total = np.zeros((2, d * d))
    for y, pos, value in summed:  # 2 d^2 rows
        total[y, pos] = value
    own = [total[k].reshape(d, d) / max(n[k] - 1, 1) for k in (0, 1)]
    pooled = (total[0] + total[1]).reshape(d, d) / max(n[0] + n[1] - 2, 1)
    for k in (0, 1):
        factor = np.linalg.cholesky(shrink(own[k], pooled))
        model.means.append(means[k])
        model.factors.append(np.linalg.inv(factor))
        model.logdets.append(float(2 * np.log(np.diag(factor)).sum()))

    bins = 512

    def histogram(batches):
        for batch in batches:
            at = np.clip(((model.difference(_matrix(batch)) + 10) * bins / 20).astype(np.int64), 0, bins - 1)
            yield pa.record_batch([pa.array(at), batch.column("y")], ["bin", "y"])

    counts = x.mapInArrow(histogram, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).toPandas()
    centre = (counts["bin"].to_numpy(float) + 0.5) * 20 / bins - 10
    model.platt = fit_platt(centre, counts["p"].to_numpy(float), (counts["n"] - counts["p"]).to_numpy(float))
    return model


def score_quality(docs: DataFrame, model: QuadraticModel) -> DataFrame:
    """(doc_id, score) for each row of `docs`; map-only. Null and empty texts have the statistics of no words.

    Texts count whole, however long; repeated rows are scored each; columns but doc_id and text are left out, whatever their names.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                x = np.array([statistics(t) for t in part.column("text").to_pylist()], float)
                yield pa.record_batch([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
