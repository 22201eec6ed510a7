"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are two halves of 32. Two fingerprints that differ in at most `MAX_BITS` = 3 bits
differ in at most one bit of some half. On a half, the anchors are a covering code: the Hamming code of
length 31 with one free bit, of covering radius 1. Every fingerprint is sent to all anchors within covering
radius plus threshold (1 + 1 = 2) of either half, and is at home at the one anchor within 1. Of a linked pair, one
half's home anchor of the one is an anchor of the other, so comparing homes with visitors, per anchor, finds all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, id_text, materialize, spread_join, table

MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: An anchor with more rows is split by the bytes of the other half.
CROWD = 256
_BLOCK = 1 << 15


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 for no words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    n, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        block = words[at : at + _BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(block[i:] for i in range(size)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                fp = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code on bits 1..31 (bit 0 is free): the xor of the set bits' positions."""
    s = np.zeros(x.shape, np.int64)
    for bit in range(1, 32):
        s ^= ((x >> bit) & 1) * bit
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 18) anchors within 2 of each 32-bit value, the home anchor first, and which of them count.

    A value at distance 0 or 1 (syndrome s) of its home codeword has at distance 2: the home with the free bit
    flipped, and, for s > 0, the 15 codewords got by flipping two bits whose positions xor to s.
    """
    s = _syndrome(half)
    home = half ^ np.where(s > 0, np.int64(1) << s, 0)
    out, use = np.zeros((len(half), 33), np.int64), np.zeros((len(half), 33), bool)
    out[:, 0], use[:, 0] = home, True
    out[:, 1], use[:, 1] = home ^ 1, True
    for i in range(1, 32):
        other = s ^ i
        out[:, 1 + i] = half ^ (np.int64(1) << i) ^ (np.int64(1) << other)
        use[:, 1 + i] = (s > 0) & (other > i)
    return out, use


def _spread(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for block in np.array_split(fp, max(1, len(fp) // 4096)):
            for side in (0, 1):
                half = (block.view(np.uint64) >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                out, use = anchors(half)
                rows, places = np.nonzero(use)
                yield pa.record_batch(
                    [pa.array(out[rows, places] | (side << 33)), pa.array(block[rows]), pa.array(places == 0)], ["anchor", "fp", "home"]
                )


def _met(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at most `max_bits` apart, some more than once.

    At a crowded anchor of one half only those meet that agree in one byte of the other half too: three bits leave one of its
    four bytes equal, so nothing is lost, a crowd is split 256 ways and its comparisons fall by about 60.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the two halves guarantee links of at most 3 bits")
    spread = materialize(distinct.select("fp").mapInArrow(_spread, "anchor long, fp long, home boolean"))
    crowds = materialize(spread.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where(f"n > {CROWD} AND homes > 0").select("anchor", "n"))
    n = spread.count()
    quiet = spread.join(crowds, "anchor", "left_anti")
    crowd = spread_join(spread, crowds, "anchor", n, "left_semi")
    other = F.when(F.col("anchor") < (1 << 33), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    byte = [F.shiftright(other, 8 * k).bitwiseAND(F.lit(255)) + 256 * k for k in range(4)]
    crowd = crowd.withColumn("byte", F.explode(F.array(*byte)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits

    def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
        homes, visitors = rows.where("home").select(*keys, F.col("fp").alias("a")), rows.select(*keys, F.col("fp").alias("b"))
        return homes.join(visitors, keys).where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return compared(quiet, ["anchor"]).union(compared(crowd, ["anchor", "byte"]))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints at most `max_bits` (3 at most) apart."""
    return _met(distinct, max_bits).distinct()


def _forest(batches):
    """Of each batch of links a spanning forest: a dense ball keeps about one link a member, and what was connected stays so."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            keep.append(x != y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        yield batch.filter(pa.array(keep, pa.bool_()))


def representative_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Some of `links` that connect all that they connect."""
    return _met(distinct, max_bits).mapInArrow(_forest, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b), a < b: root is the least node reachable.

    Alternates large-star and small-star steps, each a min by node and a join, until nothing changes; the
    number of rounds grows with the logarithm of the longest chain. A node that a third of all edges meet is joined
    where its edges lie. Nothing but two numbers reaches the driver.
    """
    edges = materialize(edges)
    seen, n = None, edges.count()
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        up = spread_join(both.where("v > u"), least, "u", 2 * n)
        large = materialize(up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        down = spread_join(large, least, "u", large.count())
        stars = F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialize(down.select(F.explode(stars).alias("e")).select("e.a", "e.b").where("a < b").distinct())
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == seen:
            break
        seen = n, total
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`.

    component_id is the smallest doc_id among all documents reachable over links. Equal fingerprints are
    one node, so a huge group of exact copies costs one row; texts without words have fingerprint 0 and link like
    any other. Null ids are carried and never are a component_id unless all ids of the component are null.
    """
    fps = materialize(fingerprints(docs))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = components(representative_links(nodes))
    grouped = materialize(nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"))
    smallest = materialize(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    n, rows = grouped.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    named = spread_join(grouped.select("fp", "copies", "root"), smallest, "root", n)
    named = materialize(named.select("fp", "component_id", F.col("copies").alias("n")))
    return spread_join(fps, named, "fp", rows).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
