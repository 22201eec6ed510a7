"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and clean documents with an informative Dirichlet prior; a linear scan
finds all maximal scoring segments of a text; the scores follow an extreme-value law whose parameters are
fitted on clean documents, which turns segments into evidence and evidence into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, fit_platt, held_out, hold, id_text, labelled_sample, materialize, table, tidy

#: Words are told apart by 2**BITS hash values, so the lexicon's size is bounded however many words there are.
BITS = 18
#: Labelled documents learned from at most (about; chosen by a hash of the id).
MAX_ROWS = 40_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
_WORD = re.compile(r"[^\W\d_]+")
_MEMO: dict[str, int] = {}
_MASK = (1 << BITS) - 1


def word_codes(text: str) -> np.ndarray:
    """(3, n): codes of each word, of its first six and of its first eight letters (the word's again where it is shorter)."""
    words = _WORD.findall(text.lower())
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    for w in (w for w in set(words) if w not in _MEMO):
        own = zlib.crc32(w.encode()) & _MASK
        six = zlib.crc32(f"{w[:6]}-".encode()) & _MASK if len(w) > 6 else own
        eight = zlib.crc32(f"{w[:8]}-".encode()) & _MASK if len(w) > 8 else six
        _MEMO[w] = own | six << BITS | eight << 2 * BITS
    packed = np.fromiter(map(_MEMO.__getitem__, words), np.int64, len(words))
    return np.stack([packed & _MASK, packed >> BITS & _MASK, packed >> 2 * BITS])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass over the positive scores.

    Each candidate links to the nearest one before it with a smaller left sum, so no candidate is looked at
    more than a bounded number of times.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, float(sums[i]), float(sums[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, _, left, _, link = stack[j]
            del stack[j:]
            j = link
        stack.append((start, i + 1, left, right, j))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


@dataclass
class ToxicityModel:
    """Log-odds by word code (words not listed have `rest`), the extreme-value law's lambda and ln K, and the logistic map."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = -0.5
    lam: float = 1.0
    ln_k: float = 0.0
    platt: tuple[float, float] = (0.0, 0.0)
    significance: float = 0.05

    def lookup(self) -> np.ndarray:
        dense = np.full(1 << BITS, self.rest)
        dense[self.codes] = self.odds
        return dense

    def segments(self, codes: np.ndarray, dense: np.ndarray) -> list[tuple[int, int, float]]:
        return maximal_segments(dense[codes].max(0))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Sum of the segments' normalised scores, and how many are significant.

        A segment of score S among n words has E = K n exp(-lambda S) chance equals; only those under the
        level add up, and without one the best alone counts (no words: the least evidence).
        """
        base = self.ln_k + math.log(max(n, 1))
        normal = sorted((self.lam * s - base for _, _, s in segments), reverse=True)
        strong = [x for x in normal if x > -math.log(self.significance)]
        return (sum(strong) if strong else normal[0] if normal else -base - 5.0), len(strong)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a + b * squash(evidence), -30, 30)))


def squash(evidence: np.ndarray) -> np.ndarray:
    return np.sign(evidence) * np.log1p(np.abs(evidence))


def _code_counts(batches):
    for batch in batches:
        size = 1 << BITS
        toxic, clean, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            codes = word_codes(text)
            (toxic if y else clean)[np.unique(codes)] += 1
            if not y:
                np.add.at(total, codes[0], 1)
        at = np.flatnonzero(toxic + clean)
        yield pa.record_batch([pa.array(x) for x in (at, toxic[at], clean[at], total[at])], ["code", "toxic", "clean", "total"])


def _lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 for scores of negative mean."""
    weight = weight / weight.sum()
    low, high = 1e-4, 1.0
    f = lambda x: float((weight * np.exp(np.clip(x * scores, -700, 700))).sum()) - 1
    if f(low) >= 0 or scores.max() <= 0:
        return 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, prior: float = 100.0, z: float = 3.5, least: float = 1.5, drift: float = 1.0) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    Words, and their first six and eight letters, count once a document; a word scores as the best of the three. `prior` documents' worth of pseudo-counts follow the words' frequency in
    both classes together; words under `z` standard errors or `least` log-odds share the rest's log-odds less `drift`, so
    that neutral text scores below zero (with many labels, standard errors alone let through words that hardly differ).
    Without labels of both classes the model gives one score to all.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, max_rows))
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    model = ToxicityModel()
    if not n1 or not n0:
        model.platt = fit_platt(np.zeros(1), np.array([n1]), np.array([n0]))
        return model
    counts = (
        sample.select("text", "y").mapInArrow(_code_counts, "code long, toxic long, clean long, total long")
        .groupBy("code").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "total"))).toPandas()  # at most 2**BITS rows
    )
    y1, y0, tf = (counts[c].to_numpy(float) for c in ("toxic", "clean", "total"))
    share = (y1 + y0 + 0.01) / (n1 + n0)
    a1, a0 = prior * share, prior * share
    odds = lambda y, a, m: np.log((y + a) / np.maximum(m + prior - y - a, 0.5))
    delta = odds(y1, a1, n1) - odds(y0, a0, n0)
    keep = np.abs(delta) / np.sqrt(1 / (y1 + a1) + 1 / (y0 + a0)) >= z
    keep &= delta > least  # words of clean text are the rest
    mass1, mass0 = y1[~keep].sum() / n1, y0[~keep].sum() / n0
    model.rest = min(math.log((mass1 + 1e-9) / (mass0 + 1e-9)), 0.0) - drift if mass0 else -drift
    model.codes, model.odds = counts["code"].to_numpy(np.int64)[keep], np.minimum(delta[keep], 5.0)
    model.lam = _lambda(np.append(model.odds, model.rest), np.append(tf[keep] + 0.01, max(tf[~keep].sum(), 1.0)))

    def best(batches):
        dense = model.lookup()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                codes = word_codes(text)
                out.append((codes.shape[1], max((s for _, _, s in model.segments(codes, dense)), default=0.0)))
            words, most = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([pa.array(words, pa.int64()), pa.array(most, pa.float64())], ["n", "best"])

    clean = sample.where("y = 0").select("text").mapInArrow(best, "n long, best double").where("n > 0")
    mean = clean.agg(F.avg(model.lam * F.col("best") - F.log("n"))).first()[0]
    model.ln_k = float(np.clip((mean or 0.0) - np.euler_gamma, -8, 8))

    bins = 512

    def histogram(batches):
        dense = model.lookup()
        for batch in batches:
            x = [model.evidence(c.shape[1], model.segments(c, dense))[0] for c in map(word_codes, batch.column("text").to_pylist())]
            at = np.clip(((squash(np.array(x, float)) + 8) * bins / 16).astype(np.int64), 0, bins - 1)
            yield pa.record_batch([pa.array(at), batch.column("y")], ["bin", "y"])

    table_ = sample.select("text", "y").mapInArrow(histogram, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).toPandas()
    at = table_["bin"].to_numpy(float)
    model.platt = fit_platt((at + 0.5) * 16 / bins - 8, table_["p"].to_numpy(float), (table_["n"] - table_["p"]).to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_passages, passages) for each row of `docs`; map-only.

    passages: the significant segments as word positions start:end:score, best first as found. Null and empty
    texts have the least evidence; repeated rows are scored each.
    """

    @tidy
    def run(batches):
        hold("toxicity", _MEMO.clear)
        dense = model.lookup()
        for batch in batches:
            for part in by_bytes(batch):
                x, strong, spans = [], [], []
                for text in part.column("text").to_pylist():
                    codes = word_codes(text)
                    found = model.segments(codes, dense)
                    evidence, k = model.evidence(codes.shape[1], found)
                    best = sorted(found, key=lambda s: (-s[2], s[0]))[:k]
                    x.append(evidence)
                    strong.append(k)
                    spans.append(",".join(f"{a}:{b}:{s:.3f}" for a, b, s in sorted(best)))
                score = model.score(np.array(x, float))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(score), pa.array(strong, pa.int32()), pa.array(spans, pa.string())],
                    ["doc_id", "score", "n_passages", "passages"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, score double, n_passages int, passages string")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score under the threshold, all columns as they are."""

    @tidy
    def run(batches):
        hold("toxicity", _MEMO.clear)
        dense = model.lookup()
        for batch in batches:
            for part in by_bytes(batch):
                found = [word_codes(t or "") for t in part.column("text").to_pylist()]
                x = [model.evidence(c.shape[1], model.segments(c, dense))[0] for c in found]
                yield part.filter(pa.array(model.score(np.array(x, float)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_passages",
        "passages",
    )
