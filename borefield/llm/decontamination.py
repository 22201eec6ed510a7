"""Benchmark decontamination with spaced seeds.

Fixed masks choose some of a run of words and ignore the others, so a hash of the chosen words survives
substitutions at the ignored positions. Hashes of benchmark and document meet, and each meeting is
verified along its diagonal: `window` words of which at least `similarity` agree. A benchmark of a checked size
is sent to all tasks, so the meeting is made where documents lie; a larger one is joined with them by hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, by_bytes, hold, id_text, materialize, table, tidy
from .suffixes import key_filter

#: Together these hit every 13 words of which any two are substituted (found by trying all masks of six words).
MASKS = ("11101011", "11001111")
WINDOW, SIMILARITY = 13, 0.8
#: Hits whose diagonals are told apart at once.
HITS = 1 << 20
#: Benchmark words, at some four characters each, up to which the benchmark is sent to all tasks.
SENT_WORDS = 2_000_000
#: Benchmark items that are verified against a text at once, on average, and tasks that a hot key's rows are dealt to on either side.
TOGETHER, SPLIT = 256, 16
#: Bits of a seed at which its filters look.
_SHIFTS = (0, 12, 24, 36)
_WORD = re.compile(r"[^\W_]+")
_MEMO: dict[str, int] = {}
_TABLE = 20


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    for w in (w for w in set(words) if w not in _MEMO):
        _MEMO[w] = xxhash.xxh64_intdigest(w.encode())
    return np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash for each place where the mask fits."""
    n = len(words) - len(mask) + 1
    h = np.full(max(n, 0), len(mask), np.uint64)
    if n > 0:
        for i in (i for i, c in enumerate(mask) if c == "1"):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Seeded:
    """A block of benchmark items: their words, and their seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, similarity: float = SIMILARITY):
        self.window, self.similarity = window, similarity
        self.items = [(i, w) for i, text in items if len(w := word_hashes(text or ""))]
        self.masks: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        short = {self._run(len(w)) for _, w in self.items if len(w) < window}
        for mask in [*MASKS, *("1" * k for k in sorted(short))]:
            use = [j for j, (_, w) in enumerate(self.items) if (len(w) >= window) == (mask in MASKS) and (mask in MASKS or self._run(len(w)) == len(mask))]
            h = [seeds(self.items[j][1], mask) for j in use]
            if sum(map(len, h)):
                all_h = np.concatenate(h)
                item = np.concatenate([np.full(len(x), j) for j, x in zip(use, h, strict=True)])
                at = np.concatenate([np.arange(len(x)) for x in h])
                order = np.argsort(all_h, kind="stable")
                seen = np.zeros(1 << _TABLE, bool)
                seen[all_h >> np.uint64(64 - _TABLE)] = True
                self.masks.append((mask, all_h[order], item[order], at[order], seen))

    def _need(self, size: int) -> int:
        return math.ceil(self.similarity * size - 1e-9)

    def masks_of(self, size: int) -> tuple[str, ...]:
        """The masks by which an item of so many words meets texts."""
        return MASKS if size >= self.window else ("1" * self._run(size),)

    def _run(self, size: int) -> int:
        """Words in a row that agree wherever the allowed substitutions fall."""
        return size // (size - self._need(size) + 1)

    def overlaps(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, first word, word after the last, words that agree) for the best verified diagonal of each item."""
        words = word_hashes(text)
        met: set[int] = set()
        for mask, hashes, item, at, seen in self.masks:
            h = seeds(words, mask)
            places = np.flatnonzero(seen[h >> np.uint64(64 - _TABLE)])
            low = np.searchsorted(hashes, h[places], "left")
            high = np.searchsorted(hashes, h[places], "right")
            # A repeated seed has many hits on few diagonals: each block of hits is reduced to its diagonals.
            p, a, n = places[high > low], low[high > low], (high - low)[high > low]
            if not len(n):
                continue
            cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1
            for first, past in zip([0, *cut.tolist()], [*cut.tolist(), len(n)], strict=True):
                k = n[first:past]
                x = np.repeat(a[first:past] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                met.update(np.unique((item[x] << 33) + (np.repeat(p[first:past], k) - at[x]) + (1 << 32)).tolist())
        best: dict[int, tuple[int, int, int]] = {}
        for code in sorted(met):
            j, shift = code >> 33, (code & ((1 << 33) - 1)) - (1 << 32)
            own = self.items[j][1]
            first, past = max(0, -shift), min(len(own), len(words) - shift)
            size = min(self.window, len(own))
            if past - first < size:
                continue
            same = own[first:past] == words[first + shift : past + shift]
            sums = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(sums[size:] - sums[:-size] >= self._need(size))
            if len(good):
                a, b = int(good[0]), int(good[-1]) + size
                found = (int(sums[b] - sums[a]), -(first + shift + a), first + shift + b)
                best[j] = max(best.get(j, (0, 0, 0)), found)
        for j, (agree, start, end) in best.items():
            yield self.items[j][0], -start, end, agree


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text); null texts and ids are left out."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")


def is_sent(items: DataFrame, sent_words: int) -> bool:
    return (items.agg(F.sum(F.length("text") + 1)).first()[0] or 0) <= 4 * sent_words


def seeded_block(items: DataFrame) -> Seeded:
    """The whole benchmark, whose size `is_sent` has checked."""
    return Seeded([tuple(r) for r in items.collect()])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rule = Seeded([])
    for batch in batches:
        for part in by_bytes(batch):
            found = []
            for text in part.column("text").to_pylist():
                words = word_hashes(text)
                found.append(np.unique(np.concatenate([seeds(words, m) for m in rule.masks_of(len(words))])) if len(words) else words)
            keys = np.repeat(part.column("item_key").to_numpy(), [len(f) for f in found])
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(keys, pa.int64())], ["seed", "item_key"])


def _meeting(filters: list[np.ndarray]):
    """Of documents whose seeds pass the filters: (doc_id, key, text, seeds)."""
    rule = Seeded([])
    masks = dict.fromkeys(m for size in range(1, rule.window + 1) for m in rule.masks_of(size))

    def passing(h: np.ndarray) -> np.ndarray:
        for have, shift in zip(filters, _SHIFTS, strict=True):
            place = (h >> np.uint64(shift)) & np.uint64((len(have) << 6) - 1)
            h = h[(have[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return h

    def run(batches):
        hold("decontamination", _MEMO.clear)
        for batch in batches:
            for part in by_bytes(batch):
                met = []
                for text in part.column("text").to_pylist():
                    words = word_hashes(text)
                    met.append(np.unique(np.concatenate([passing(seeds(words, m)) for m in masks])).view(np.int64))
                part = part.append_column("seeds", pa.array(met, pa.list_(pa.int64())))
                yield part.filter(pa.array([len(m) > 0 for m in met], pa.bool_()))

    return run


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join where rows of hot keys, over one in HOT of all of a side, meet in a grid of SPLIT x SPLIT tasks.

    Fewer than 2 HOT keys are hot, so their list may be sent to all. Both sides are read more than once and must be stable.
    """
    sides = [side.groupBy(key).count().where(F.col("count") > side.count() // HOT) for side in (left, right)]
    hot = F.broadcast(sides[0].unionByName(sides[1]).select(key).distinct().withColumn("hot", F.lit(True)))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT)).cast("int")
        marked = side.join(hot, key, "left").withColumn(own, F.when(F.col("hot"), at).otherwise(0))
        copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
        return marked.withColumn(other, F.explode(copies)).drop("hot")

    return dealt(left, "a", "b").join(dealt(right, "b", "a"), [key, "a", "b"]).drop("a", "b")


_FOUND = "item_id long, start_word long, end_word long, n_same long, similarity double"


def _joined(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of documents that may overlap an item, and (key, overlap) of each text and item that do; the key is a text's digest.

    One scan of the documents: those with a seed that passes the filters are written with their text. Their seeds, of
    each text once, are joined with those of the items; each pair of text and item that meets is verified.
    """
    items = materialize(items.withColumn("item_key", F.xxhash64("item_id", "text")))
    item_seeds = materialize(items.dropDuplicates(["item_key"]).select("item_key", "text").mapInArrow(tidy(_item_seeds), "seed long, item_key long"))
    filters = [key_filter(item_seeds.select(F.shiftrightunsigned("seed", shift).alias("key"))) for shift in _SHIFTS]
    keyed = id_text(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    met = materialize(keyed.mapInArrow(tidy(_meeting(filters)), "doc_id long, text string, key binary, seeds array<long>"))
    hits = materialize(met.select("key", F.explode("seeds").alias("seed")).distinct())
    pairs = materialize(split_join(hits, item_seeds, "seed").select("key", "item_key").distinct())
    sizes = pairs.groupBy("key").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    parted = materialize(split_join(pairs, materialize(sizes), "key").select("key", "item_key", F.pmod("item_key", "parts").alias("part")))
    groups = split_join(parted, items, "item_key").groupBy("key", "part").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"))).alias("items"))
    texts = met.groupBy("key").agg(F.first("text").alias("text"))

    @tidy
    def verify(batches):
        hold("decontamination", _MEMO.clear)
        for batch in batches:
            for key, text, own in zip(*(batch.column(c) for c in ("key", "text", "items")), strict=True):
                block = Seeded([(i["item_id"], i["item"]) for i in own.as_py()])
                rows = [(key.as_py(), i, a, b, same, same / (b - a)) for i, a, b, same in block.overlaps(text.as_py())]
                if rows:
                    types = [pa.binary(), *[pa.int64()] * 4, pa.float64()]
                    names = ["key", "item_id", "start_word", "end_word", "n_same", "similarity"]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = split_join(materialize(texts), materialize(groups), "key").mapInArrow(verify, f"key binary, {_FOUND}")
    return met.select("doc_id", "key"), materialize(found)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, n_same, similarity): a row for each document and item that overlap.

    Documents are scanned once. Map-only where the benchmark has at most `sent_words` words and is sent to all tasks; else
    joined by seed. Items under WINDOW words must agree as wholes, but for a fifth of their words, so one of up to four words must be
    there as it is. Null and empty texts overlap nothing; repeated rows are reported each; an empty benchmark gives no rows.
    """
    items = benchmark_items(benchmark)
    if not is_sent(items, sent_words):
        return split_join(*_joined(docs, items), "key").drop("key")
    block = seeded_block(items)

    @tidy
    def run(batches):
        hold("decontamination", _MEMO.clear)
        for batch in batches:
            for part in by_bytes(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    rows += [(doc_id, i, a, b, same, same / (b - a)) for i, a, b, same in block.overlaps(text)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64()] * 5 + [pa.float64()]
                names = ["doc_id", "item_id", "start_word", "end_word", "n_same", "similarity"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return id_text(docs).mapInArrow(run, f"doc_id long, {_FOUND}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """The rows of `docs` that overlap no benchmark item, all columns as they are.

    Beyond `sent_words` the digests of contaminated texts leave by an anti join, by broadcast up to a million of them; else both
    sides are shuffled, every text's rows dealt to SPLIT tasks.
    """
    items = benchmark_items(benchmark)
    if is_sent(items, sent_words):
        block = seeded_block(items)

        @tidy
        def run(batches):
            hold("decontamination", _MEMO.clear)
            for batch in batches:
                for part in by_bytes(batch):
                    clean = [next(block.overlaps(t or ""), None) is None for t in part.column("text").to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    bad = materialize(_joined(docs, items)[1].select(F.col("key").alias("__key")).distinct())
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    if bad.count() <= 1_000_000:
        return keyed.join(F.broadcast(bad), "__key", "left_anti").select(docs.columns)
    dealt = keyed.withColumn("__at", F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT)).cast("int"))
    everywhere = bad.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return dealt.join(everywhere, ["__key", "__at"], "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
