"""The quadratic discriminant against plain numpy."""

import zlib

import numpy as np
import pytest
from conftest import SMALL

from borefield.llm import quality


def test_densities_are_those_of_the_definition(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    learned = [i for i in docs if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    x = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    own = [np.array([x[i] for i in learned if labels[i] == k]) for k in (0, 1)]
    assert min(map(len, own)) > 5
    centred = [o - o.mean(0) for o in own]
    covariance = [c.T @ c / (len(c) - 1) for c in centred]
    pooled = sum(c.T @ c for c in centred) / (len(learned) - 2)
    density = []
    for o, c in zip(own, covariance, strict=True):
        mixed = 0.9 * c + 0.1 * pooled
        mixed = 0.9 * mixed + 0.1 * np.diag(np.diag(mixed)) + 1e-4 * np.eye(len(mixed))
        inverse, (_, logdet) = np.linalg.inv(mixed), np.linalg.slogdet(mixed)
        density.append({i: -0.5 * (v - o.mean(0)) @ inverse @ (v - o.mean(0)) - 0.5 * logdet for i, v in x.items()})
    model = quality.fit_quality(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    ids = sorted(docs)
    difference = np.array([density[1][i] - density[0][i] for i in ids])
    squashed = np.sign(difference) * np.log1p(np.abs(difference))
    assert model.difference(np.array([x[i] for i in ids])) == pytest.approx(squashed, rel=1e-6, abs=1e-6)
    a, b = model.platt
    scores = {r.doc_id: (r.score, r.held_out, r.predicted) for r in quality.op7_quality_classifier(spark, SMALL).collect()}
    for i, d in zip(ids, squashed, strict=True):
        score = 1 / (1 + np.exp(-(a + b * d)))
        assert scores[i][0] == pytest.approx(score, abs=1e-6) and scores[i][1] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert scores[i][2] == int(scores[i][0] >= 0.5)
