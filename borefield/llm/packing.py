"""Best-fit packing: exact complements first, then best fit, over counts of lengths.

Single, pair and triple sums of lengths are indexed, and combinations that fill a gap exactly are consumed from
the index under the counts. The plan works on the histogram of piece lengths (at most `capacity` rows however large the corpus), so it
is made on the driver; pieces find their places by their rank within their length, ranked in salted
buckets so that a very common length is spread over many tasks.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, id_text, materialize, table, tidy
from .tokenizing import encoder

#: Bytes of text encoded at once: what a worker holds grows with it.
ENCODED = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a text's ids, then `end_id`; longer ones cut at `capacity`.

    Null and empty texts give one piece of one id. Repeated rows give pieces each.
    """

    @tidy
    def run(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            for part in by_bytes(batch, limit=ENCODED):
                found, sizes = own.encode_all(part.column("text").to_pylist())
                ends = np.cumsum(sizes + 1)
                ids = np.full(int(ends[-1]), end_id, "<u4")
                own_ids = np.ones(len(ids), bool)
                own_ids[ends - 1] = False
                ids[own_ids] = found
                pieces = -(-(sizes + 1) // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, (sizes + 1)[doc] - start)
                past = np.cumsum(length)
                raw = memoryview(ids).cast("B")
                checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((past - length).tolist(), past.tolist(), strict=True)]
                arrays = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(checks, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, past), pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return id_text(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class _Complements:
    """Lengths in stock and an index of their single, pair and triple sums, consumed as counts run out.

    Of each sum the index lists the combinations of lengths that make it, the largest length first, and how far that list
    is used up. Counts only fall, so a combination that lacks a length never comes back and is passed once. A triple is
    a length and a smaller pair sum, so that the index has O(capacity^2) entries.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[list(counts)] = list(counts.values())
        lengths = np.flatnonzero(self.left)[::-1]
        self.pairs = self._by_sum(lengths, lengths, capacity)
        sums = np.flatnonzero(np.diff(self.pairs[1]))
        self.triples = self._by_sum(lengths, sums, capacity)
        self.used = {"pairs": self.pairs[1][:-1].copy(), "triples": self.triples[1][:-1].copy()}

    @staticmethod
    def _by_sum(first: np.ndarray, second: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        """(first lengths in order of their sum with a second one, where each sum's run starts)."""
        sums = np.add.outer(first, second)
        rows, columns = np.nonzero(sums <= capacity)
        sums = sums[rows, columns]
        order = np.lexsort((-first[rows], sums))
        return first[rows][order], np.searchsorted(sums[order], np.arange(capacity + 2))

    def take(self, lengths: list[int]) -> int:
        """How often all of `lengths` can be taken together."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def filling(self, gap: int, first: list[int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly with `first` in use."""
        if not gap or self.take([*first, gap]):
            return [gap][: int(gap > 0)]
        return self._pair(gap, first, gap) or self._triple(gap, first)

    def _pair(self, gap: int, first: list[int], most: int) -> list[int] | None:
        """The pair of that sum whose larger length, `most` at most, is the largest."""
        a_of, starts = self.pairs
        at, end = int(self.used["pairs"][gap]), int(starts[gap + 1])
        while at < end and not self._whole(int(a_of[at]), gap - int(a_of[at])):
            at += 1
        self.used["pairs"][gap] = at
        for a in map(int, a_of[at:end]):
            if 2 * a < gap:
                return None
            if a <= most and self.take([*first, a, gap - a]):
                return [a, gap - a]
        return None

    def _triple(self, gap: int, first: list[int]) -> list[int] | None:
        a_of, starts = self.triples
        at, end = int(self.used["triples"][gap]), int(starts[gap + 1])
        while at < end and not (self.left[a_of[at]] and self.used["pairs"][gap - a_of[at]] < self.pairs[1][gap - a_of[at] + 1]):
            at += 1
        self.used["triples"][gap] = at
        for a in map(int, a_of[at:end]):
            if 3 * a < gap:
                return None
            if self.take([*first, a]) and (two := self._pair(gap - a, [*first, a], a)):
                return [a, *two]
        return None

    def _whole(self, a: int, b: int) -> bool:
        return bool(self.left[a] and self.left[b] and (a != b or self.left[a] > 1))


def plan_packing(counts: dict[int, int], capacity: int = 2048) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence in order, how many such sequences)] that use every piece once.

    Largest first, each length looks up a single, a pair or a triple of lengths that exactly fills its gap
    and takes as many as the counts allow; each such step uses up a length, so there are O(capacity) of them.
    What has no exact complement is placed by best fit, decreasing.
    """
    stock, bins = _Complements(counts, capacity), []
    residual: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while n := int(stock.left[length]):
            fill = stock.filling(capacity - length, [length])
            if fill is None:
                residual[length], stock.left[length] = n, 0
                break
            times = stock.take([length, *fill])
            for x in (length, *fill):
                stock.left[x] -= times
            bins.append(([length, *fill], times))
    return bins + _best_fit(residual, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing, over groups of equal open sequences."""
    rooms: list[int] = []  # sorted, distinct
    opened: dict[int, list[tuple[list[int], int]]] = {}

    def put(room: int, lengths: list[int], n: int) -> None:
        if n:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((lengths, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put(capacity - each * length, [length] * each, n // each)
                put(capacity - n % each * length, [length] * (n % each), int(n % each > 0))
                break
            room = rooms[at]
            lengths, m = opened[room].pop()
            if not opened[room]:
                del opened[room], rooms[at]
            used = min(n, m)
            put(room, lengths, m - used)
            put(room - length, [*lengths, length], used)
            n -= used
    return [group for groups in opened.values() for group in groups]


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32, deal, ...) with sequence_id and offset, without `deal`.

    `deal` is a number from 0 up to 1 for each piece, drawn when it was written, so that pieces of one id or without id are dealt like
    all others. `pieces` is read three times and must be stable (a table or checkpoint). No piece is dropped; equal
    rows take places in any order. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    cursor, segments, sequence = dict.fromkeys(counts, 0), [], 0
    for lengths, times in plan_packing(counts, capacity):
        offset = 0
        for length in lengths:
            segments.append((length, cursor[length], cursor[length] + times, sequence - cursor[length], offset))
            cursor[length] += times
            offset += length
        sequence += times
    slots = spark.createDataFrame(segments, "length long, first long, past long, shift long, offset long")
    each = max(256, math.isqrt(sum(counts.values())))
    salts = spark.createDataFrame([(k, max(1, v // each)) for k, v in counts.items()], "length long, salts long")

    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.floor(F.col("deal") * F.col("salts"))).drop("salts")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("deal")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    slots = slots.withColumnRenamed("length", "slot_length")
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    return (
        ranked.join(F.broadcast(slots), here)  # O(capacity) rows, see plan_packing
        .withColumn("sequence_id", F.col("rank") + F.col("shift"))
        .drop("slot_length", "first", "past", "shift", "within", "before", "rank", "salt", "deal")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of `docs` with their place in sequences of at most `capacity` ids; `with_ids` adds the ids."""
    return place(materialize(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids).withColumn("deal", F.rand(0))), capacity)


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(columns)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
