"""First-fit decreasing with a tournament tree of bin capacities, run for itself in each randomised group of documents.

Rows are dealt at random; every task cuts what it gets into groups of about GROUP tokens, and each group is packed alone, so
nothing is collected and one very long document is a group of its own. Sequences are padded to the capacity except at a
power of two. As documents may be cut, what first fit leaves open is closed: the emptiest bins give their pieces to the
gaps of the fullest, and the one that is left in the end is laid out in sequences of powers of two. So no padding is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, id_text, table, tidy
from .tokenizing import encoder

#: Tokens of a group; the last one of a task may have fewer, a longer document makes a larger one.
GROUP = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"
Piece = tuple[int, int, int]  # document, start, length


class TournamentTree:
    """Room of bins, each inner node the most of its two; the first bin with enough room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.width)

    def take(self, size: int) -> int:
        """The first bin with room for `size`, which it loses."""
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.width
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Bins of pieces, the largest placed first, each in the first bin that has room."""
    tree, bins = TournamentTree(len(pieces), capacity), []
    for piece in sorted(pieces, key=lambda p: -p[2]):
        at = tree.take(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return bins


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """(pieces of exactly `size` tokens, the rest), the last one cut where it has to be."""
    out, rest = [], list(reversed(pieces))
    while size:
        doc, start, length = rest.pop()
        taken = min(length, size)
        out.append((doc, start, taken))
        if taken < length:
            rest.append((doc, start + taken, length - taken))
        size -= taken
    return out, rest[::-1]


def close_gaps(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The same tokens in full bins and bins of powers of two."""
    used = [sum(p[2] for p in b) for b in bins]
    full = [b for b, n in zip(bins, used, strict=True) if n == capacity]
    open_ = sorted((n, i) for i, n in enumerate(used) if n < capacity)
    lent: list[Piece] = []
    spare = 0
    low, high = 0, len(open_) - 1
    while low <= high:
        n, i = open_[high]
        high -= 1
        while spare < capacity - n and low <= high:  # the emptiest bins lend what they hold
            lent += sorted(bins[open_[low][1]], key=lambda p: -p[2])
            spare += open_[low][0]
            low += 1
        gap = min(capacity - n, spare)
        more, lent = _cut(lent, gap)
        spare -= gap
        if n + gap == capacity:
            full.append(bins[i] + more)
        else:
            lent, spare = bins[i] + more, n + gap
    while spare:
        size = min(capacity, 1 << (spare.bit_length() - 1))
        own, lent = _cut(lent, size)
        full.append(own)
        spare -= size
    return full


def pack_group(sizes: np.ndarray, capacity: int) -> list[list[Piece]]:
    """Sequences for documents of `sizes` tokens: longer ones give whole sequences first, what is left of them takes part."""
    whole = [[(doc, at, capacity)] for doc in np.flatnonzero(sizes >= capacity).tolist() for at in range(0, int(sizes[doc]) - capacity + 1, capacity)]
    left = [(doc, n - n % capacity, n % capacity) for doc, n in enumerate(sizes.tolist()) if n % capacity]
    return whole + close_gaps(first_fit_decreasing(left, capacity), capacity)


def _groups(batches: Iterator[pa.RecordBatch], own, end_id: int, group: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, tokens of each document with its last id, all ids) of groups of about `group` tokens."""
    docs, sizes, ids, total = [], [], [], 0
    for batch in batches:
        for part in by_bytes(batch):
            found, counts = own.encode_all(part.column("text").to_pylist())
            ends = np.cumsum(counts + 1)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = found
            docs.append(part.column("doc_id"))
            sizes.append(counts + 1)
            ids.append(flat)
            total += len(flat)
            if total >= group:
                yield pa.concat_arrays(docs), np.concatenate(sizes), np.concatenate(ids)
                docs, sizes, ids, total = [], [], [], 0
    if docs:
        yield pa.concat_arrays(docs), np.concatenate(sizes), np.concatenate(ids)


def pack_first_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, seed: int = 0, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): every id of every document in one piece of one sequence.

    Null and empty texts are one id. Repeated rows are packed each; rows without id or of one id are dealt like all others; other
    columns are not read; an empty table gives an empty one. `capacity` is a power of two. `docs` is a table or a checkpoint: rows are dealt by their place in it.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    @tidy
    def run(batches):
        sequence = 0
        for doc_ids, sizes, ids in _groups(batches, encoder(tokenizer_path), end_id, group):
            packed = pack_group(sizes, capacity)
            lengths = np.array([len(b) for b in packed])
            doc, start, length = np.array([p for b in packed for p in b], np.int64).T
            past = np.cumsum(length)
            firsts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            offset = past - length - (past - length)[firsts]
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            raw = memoryview(ids).cast("B")
            checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            numbers = sequence + np.repeat(np.arange(len(packed)), lengths)
            arrays = [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(checks, pa.int64()), pa.array(sizes[doc].astype(np.int64)), pa.array(numbers), pa.array(offset)]
            if with_ids:
                arrays.append(pa.array([ids[a:b].view("<i4") for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.list_(pa.int32())))
            sequence += len(packed)
            yield pa.record_batch(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids"][: len(arrays)])

    dealt = id_text(docs).withColumn("deal", F.rand(seed)).repartition("deal").drop("deal")
    packed = dealt.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))
    of_task = F.shiftleft(F.spark_partition_id().cast("long"), 33)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return packed.withColumn("sequence_id", of_task + F.col("sequence")).select(columns)


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_first_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
