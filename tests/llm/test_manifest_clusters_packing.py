"""Operators 11 to 13 against brute-force versions, and on odd inputs."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from borefield.llm import centroids, first_fit, manifest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string, n_chars long, at int, hash string, n int, tree int, path string, name string"

# 11


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def slow_levels(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def slow_path(levels, at):
    path = []
    for level in levels[:-1]:
        first = at // 16 * 16
        path.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return path


def slow_manifest(rows):
    """[(doc_id, leaf, subroot, root, proof, folded, verified)] of rows as dicts."""
    leaf = lambda r, text: sha(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = slow_levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            text, doc_id = r["text"], r["doc_id"]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            path, h = slow_path(trees[s], at) + slow_path(top, k), leaf(r, text)
            for before, after in path:
                h = sha(*before, h, *after)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(*(x for pair in path for side in pair for x in side)), h, h == top[-1][0]))
    return out


def found_manifest(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    df = manifest.manifest(docs, alter={"text": text})
    folded = manifest.fold(F.coalesce("altered", "leaf"), F.col("path"), F.col("steps"))
    rows = df.select("doc_id", "leaf", "subroot", "root", F.sha2("path", 256), folded.alias("f"), (folded == F.col("root")).alias("v")).collect()
    return [tuple(r) for r in rows]


def by_text(rows):
    return sorted(rows, key=repr)


def test_manifest(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert by_text(map(tuple, manifest.op11_merkle_manifest(spark, SMALL).collect())) == by_text(slow_manifest(rows))


@pytest.mark.parametrize("names_bytes", [manifest.NAMES_BYTES, 0])
def test_manifest_of_odd_rows(spark, monkeypatch, names_bytes):
    """A large source, many small ones, lone leaves, null and empty values, repeated rows and ids, a hot null id, clashing columns, many parts."""
    monkeypatch.setattr(manifest, "NAMES_BYTES", names_bytes)
    rows = [(i, f"Text {i} Ü", "big", "en", i) for i in range(300)] + [(None, "Same", "big", None, None)] * 120
    rows += [(i % 7, None if i % 3 else "", f"s{i % 20}", "de", i % 2) for i in range(60)] + [(5, "X", None, "en", 1), (5, "X", "", "en", 1), (6, "ALONE" * 9_000, "é", "", 0)]
    docs = spark.createDataFrame([(*r, 1, "h", 2, 3, "p", "n") for r in rows], DOCS)
    expect = slow_manifest([dict(zip(("doc_id", "text", "source", "lang", "n_chars"), r, strict=True)) for r in rows])
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert by_text(found_manifest(docs)) == by_text(expect)
        assert manifest.manifest(docs.limit(0)).collect() == []
        alone = manifest.manifest(docs.where("source = 'é'")).collect()
        assert [(r.leaf == r.root, r.path, r.steps) for r in alone] == [(True, "", [])]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(not r[-1] for r in expect) > 20


# 12


def slow_nearest(x, c):
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def test_partial_distances_lose_nothing():
    rng = np.random.default_rng(3)
    for spread in (1, 3, 1000):
        x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (40, 64))
        c[7] = c[3]  # equal centroids: the smaller number wins
        x[:40] = c
        order = rng.permutation(64)
        for got, want in zip(centroids.nearest(x, c, order), slow_nearest(x, c), strict=True):
            assert (got == want).all()


def slow_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], np.int64)
    c = x[:k].copy()
    for _ in range(rounds):
        own = slow_nearest(x, c)[0]
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [sum(col) // int((own == j).sum()) for col in x[own == j].T.tolist()]
    own, d = slow_nearest(x, c)
    text = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    return [(i, int(j), int(e), int(d[own == j].sum()), int(d.sum()), text[j]) for (i, _), j, e in zip(kept, own, d, strict=True)]


def test_clusters(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert by_text(map(tuple, centroids.op12_centroid_clustering(spark, SMALL).collect())) == by_text(slow_clusters(rows))


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    fine = [(i, rng.normal(size=64).round(1).tolist()) for i in range(90)] + [(7, [0.5] * 64)] * 60 + [(None, [0.25] * 64)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] + [1.0] * 63), (106, [float("inf")] * 64)]
    schema = "vec_id long, embedding array<double>, cluster string, v int"
    df = spark.createDataFrame([(*r, "c", 1) for r in fine + bad], schema)
    assert by_text(map(tuple, centroids.cluster(df.repartition(5)).collect())) == by_text(slow_clusters(fine + bad))
    few = centroids.cluster(df.where("vec_id < 3")).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}
    assert centroids.cluster(df.where("vec_id > 99")).collect() == [] and centroids.cluster(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [2.0**30] * 64, "c", 1)], schema)).collect()


# 13


def slow_first_fit(sizes, capacity):
    room, out = [], []
    for size in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= size), len(room))
        if at == len(room):
            room.append(capacity)
            out.append([])
        room[at] -= size
        out[at].append(size)
    return out


def test_the_tournament_finds_the_first_fit():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 7, 64, 65, 300):
        sizes = rng.integers(1, 65, n).tolist()
        got = first_fit.first_fit_decreasing([(i, 0, s) for i, s in enumerate(sizes)], 64)
        assert [[p[2] for p in b] for b in got] == slow_first_fit(sizes, 64)


def test_groups_have_no_padding_and_lose_nothing():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = rng.integers(1, rng.choice([3, 40, 64, 300]), rng.integers(1, 60))
        packed = first_fit.pack_group(sizes, 64)
        ids = [(doc, at) for b in packed for doc, start, n in b for at in range(start, start + n)]
        assert sorted(ids) == [(doc, at) for doc, n in enumerate(sizes.tolist()) for at in range(n)]
        for b in packed:
            n = sum(p[2] for p in b)
            assert n <= 64 and n & (n - 1) == 0 and all(p[2] > 0 for p in b)
        assert sum(sum(p[2] for p in b) < 64 for b in packed) <= 6
        assert sum(map(len, packed)) <= len(sizes) + 2 * len(packed)  # a cut at most for each sequence and end


def check_first_fit(rows, texts, capacity):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    whole = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole[i]) and r.ids_crc32 == zlib.crc32(whole[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole[i])
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0


@pytest.mark.parametrize("group", [first_fit.GROUP, 5_000])
def test_first_fit_packing(spark, group):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = first_fit.op13_first_fit_packing(spark, SMALL) if group == first_fit.GROUP else first_fit.pack_first_fit(docs, WORDS, group=group)
    check_first_fit(packed.collect(), {r.doc_id: r.text for r in docs.collect()}, 4096)


def test_first_fit_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "same words here", 4: " ".join(f"word{i % 977}" for i in range(60_000)), None: "no id " * 60, 5: "  ünï\x0b"}
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in texts.items()], "doc_id long, text string, length string, sequence int")
    check_first_fit(first_fit.pack_first_fit(docs, WORDS).collect(), texts, 4096)
    check_first_fit(first_fit.pack_first_fit(docs, WORDS, capacity=64).collect(), texts, 64)
    alike = first_fit.pack_first_fit(spark.createDataFrame([(3, "same words here")] * 50, "doc_id long, text string"), WORDS, 256, with_ids=True).collect()
    assert sum(r.length for r in alike) == 50 * alike[0].doc_tokens and all(len(r.ids) == r.length for r in alike)
    assert first_fit.pack_first_fit(docs.limit(0), WORDS).collect() == []
    with pytest.raises(ValueError):
        first_fit.pack_first_fit(docs, WORDS, capacity=100)
