"""Repeated passages with a sparse suffix array.

Of each window of `MIN_WORDS` words the least hash of its 25-word runs chooses positions (minimisers); only suffixes at
such positions are kept. Equal windows choose equal positions, so two documents that share a window have two suffixes
that begin with the same run, and the window lies within 25 words before and 25 after that run. Suffixes whose run another
document has are kept with these words as text, equal ones as one, and sorted by what follows; neighbours are compared
word by word and matches extended to the left and right. As one suffix may share more to the right and another more to the
left, the suffixes are also sorted by what precedes. A suffix shares nowhere more than with its neighbours, so the two orders
bound what it may share; windows within the bounds that no neighbour has shown are looked up one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, by_bytes, hold, id_text, materialize, spread_join, table
from .words import by_text, hashed_words, runs

MIN_WORDS = 50
#: Windows of a position are bits of a long.
MOST_WORDS = 124
#: Longer words are compared by their 128-bit hash.
_LONG_WORD = 64


def least(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each `size` values in a row."""
    span = 1
    while 2 * span <= size:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def chosen(h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, run hashes there) that windows of `min_words` words choose, ties included; none for shorter texts.

    A run is chosen where the greatest minimum of the windows around it is its own hash.
    """
    if len(h) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size = min_words // 2
    reach = min_words - size
    run, edge = runs(h, size), np.zeros(reach, np.uint64)
    most = ~least(~np.concatenate([edge, least(run, reach + 1), edge]), reach + 1)
    at = np.flatnonzero(most == run)
    return at, run[at]


def _keys(min_words: int):
    def run(batches):
        hold("suffixes")
        for batch in batches:
            for part in by_bytes(batch):
                keys = [np.unique(chosen(h, min_words)[1]) for h in by_text(*hashed_words(part.column("text")))]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(k) for k in keys])
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return run


def repeated_keys(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key): hashes of chosen runs that two documents have; a suffix that begins with another run has no match."""
    suffixes = docs.mapInArrow(_keys(min_words), "key long, doc_id long")
    return suffixes.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap with one place for each key hash: 16 places a key, between 2**16 and 2**28 in all (32 MB).

    It only spares suffixes without a match the way to the sort; those it lets through by chance find no neighbour there.
    """
    bits = int(np.clip(np.ceil(np.log2(16 * max(keys.count(), 1))), 16, 28))
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


_CONTEXT = pa.schema([("ctx", pa.binary()), ("key", pa.int64()), ("after", pa.binary()), ("before", pa.binary()), ("doc_id", pa.int64()), ("word", pa.int64())])


def _ended(word: bytes) -> bytes:
    return (word if len(word) <= _LONG_WORD else b"\0" + xxhash.xxh3_128_hexdigest(word).encode()) + b" "


def _contexts(have: np.ndarray, min_words: int):
    low, size = np.uint64((len(have) << 6) - 1), min_words // 2
    reach = min_words - size

    def run(batches):
        hold("suffixes")
        for batch in batches:
            for part in by_bytes(batch):
                rows, held = [], 0
                for i, h in enumerate(by_text(*hashed_words(part.column("text")))):
                    at, keys = chosen(h, min_words)
                    place = keys & low
                    hit = (have[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    if not hit.any():
                        continue
                    doc_id = part.column("doc_id")[i].as_py()
                    words = [_ended(w) for w in part.column("text")[i].as_py().encode().lower().split()]
                    for p, key in zip(at[hit].tolist(), keys[hit].view(np.int64).tolist(), strict=True):
                        after = b"".join(words[p + size : p + size + reach])
                        before = b"".join(words[max(0, p - reach) : p][::-1])
                        ctx = xxhash.xxh3_128_digest(b"%d\n%b\n%b" % (key, after, before))
                        rows.append((ctx, key, after, before, doc_id, p))
                        held += len(after) + len(before) + 100
                        if held > BATCH_BYTES:
                            yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_CONTEXT)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=_CONTEXT)

    return run


def in_common(a: bytes, b: bytes) -> int:
    """How many words, each ended by a blank, two texts begin with alike."""
    if a == b:
        return a.count(b" ")
    n = 0
    for x, y in zip(a.split(b" "), b.split(b" "), strict=False):
        if x != y:
            break
        n += 1
    return n


def _bits(first: int, last: int) -> int:
    return (1 << (last + 1)) - (1 << first) if last >= first else 0


_MARKS = pa.schema([("ctx", pa.binary()), ("key", pa.int64()), ("copies", pa.int64()), ("shared", pa.int64()), ("possible", pa.int64())])


def _neighbours(reach: int, by_after: bool):
    """Of sorted suffixes: which windows (bit l: the one that begins l words before the run) a neighbour shares, which any other may.

    What lies beyond a task's first and last suffix isn't known, so there all windows may be shared.
    """

    def pair(a, b):
        if a["key"] != b["key"]:
            return 0, 0
        after, before = in_common(a["after"], b["after"]), in_common(a["before"], b["before"])
        one_document = a["low"] == a["high"] == b["low"] == b["high"]
        return 0 if one_document else _bits(reach - after, before), _bits(reach - after, reach) if by_after else _bits(0, before)

    def run(batches):
        hold("suffixes")
        last = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = _bits(reach - row["after"].count(b" "), row["before"].count(b" "))
                if last is None:
                    shared, possible = 0, own
                else:
                    shared, possible = pair(last[0], row)
                    out.append(last[1:4] + (last[4] | shared, last[5] | possible))
                last = row, row["ctx"], row["key"], row["copies"], shared | (own if row["low"] < row["high"] else 0), possible
            yield pa.record_batch(list(map(list, zip(*out, strict=True))) or [[]] * 5, schema=_MARKS)
        if last is not None:
            own = _bits(reach - last[0]["after"].count(b" "), last[0]["before"].count(b" "))
            yield pa.record_batch([[x] for x in last[1:5] + (last[5] | own,)], schema=_MARKS)

    return run


_WINDOW = pa.schema([("window", pa.binary()), ("ctx", pa.binary()), ("bit", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _windows(reach: int):
    """Each window of suffixes that column `open` asks for and that has all its words."""

    def run(batches):
        hold("suffixes")
        for batch in batches:
            for row in batch.to_pylist():
                after, before, out = row["after"].split(b" ")[:-1], row["before"].split(b" ")[:-1], []
                for n in range(max(0, reach - len(after)), min(reach, len(before)) + 1):
                    if row["open"] >> n & 1:
                        words = b" ".join([*before[:n], b"", *after[: reach - n]])
                        out.append((xxhash.xxh3_128_digest(b"%d\n%d\n%b" % (row["key"], n, words)), row["ctx"], 1 << n, row["low"], row["high"]))
                if out:
                    yield pa.record_batch(list(map(list, zip(*out, strict=True))), schema=_WINDOW)

    return run


def shared_windows(contexts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(ctx, shared, n): of each different suffix the windows that another document has (bits), and how many positions have it.

    A suffix is ranged by key and all its words, so that one run a third of all documents share is spread over tasks;
    suffixes that are equal as far as `min_words` asks are one row.
    """
    reach = min_words - min_words // 2
    copies = [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("copies")]
    suffixes = materialize(contexts.groupBy("ctx", "key", "after", "before").agg(*copies))
    marks = []
    for order in (["key", "after", "before"], ["key", "before", "after"]):
        array = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
        marks.append(array.mapInArrow(_neighbours(reach, order[1] == "after"), "ctx binary, key long, copies long, shared long, possible long"))
    met = marks[0].unionByName(marks[1]).groupBy("ctx", "key", "copies").agg(F.bit_or("shared").alias("shared"), F.bit_and("possible").alias("possible"))
    found = materialize(met.withColumn("open", F.expr("possible & ~shared")))

    asked = materialize(found.groupBy("key").agg(F.bit_or("open").alias("open"), F.count("*").alias("n")).where("open <> 0"))
    known = found.where("shared <> 0").select("ctx", "copies", "shared")
    if asked.head(1):
        rivals = spread_join(suffixes, asked, "key", suffixes.count())
        windows = materialize(rivals.mapInArrow(_windows(reach), "window binary, ctx binary, bit long, low long, high long"))
        twice = windows.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).where("low < high")
        kept = spread_join(windows.select("window", "ctx", "bit"), materialize(twice.select("window", "n")), "window", windows.count(), "left_semi")
        more = kept.groupBy("ctx").agg(F.bit_or("bit").alias("shared")).join(found.select("ctx", "copies"), "ctx")
        known = known.unionByName(more)
    return materialize(known.groupBy("ctx").agg(F.bit_or("shared").alias("shared"), F.max("copies").alias("n")))


def _merge(min_words: int):
    reach = min_words - min_words // 2

    def run(batches):
        for batch in batches:
            ids, start, end = [], [], []
            for doc_id, at in zip(batch.column("doc_id").to_pylist(), batch.column("at"), strict=True):
                word, shared = (at.values.field(x).to_numpy(zero_copy_only=False) for x in ("word", "shared"))
                at = np.unique(np.concatenate([word[(shared >> n) & 1 == 1] - n for n in range(reach + 1)]))
                cut = np.flatnonzero(np.diff(at) > min_words)
                start += at[np.concatenate([[0], cut + 1])].tolist()
                end += (at[np.concatenate([cut, [len(at) - 1]])] + min_words).tolist()
                ids += [doc_id] * (len(cut) + 1)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids, start, end)], ["doc_id", "start_word", "end_word"])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the passages of at least `min_words` words that another document has too.

    Words are runs without ASCII white space, A-Z lower-cased; overlapping or touching passages of a document are one
    span. A passage counts where two documents have it, the first included; what only repeats inside a document doesn't.
    Rows of one doc_id are one document, rows without one take no part; null, empty and shorter texts have no spans.
    `min_words` is 2 to 124.
    """
    if not 2 <= min_words <= MOST_WORDS:
        raise ValueError(f"min_words must be 2 to {MOST_WORDS}, not {min_words}")
    docs = id_text(docs).where("doc_id IS NOT NULL")
    have = key_filter(materialize(repeated_keys(docs, min_words)))
    contexts = materialize(docs.mapInArrow(_contexts(have, min_words), "ctx binary, key long, after binary, before binary, doc_id long, word long"))
    positions = contexts.select("ctx", "doc_id", "word")
    placed = spread_join(positions, shared_windows(contexts, min_words), "ctx", positions.count())
    found = placed.groupBy("doc_id").agg(F.collect_list(F.struct("word", "shared")).alias("at"))
    spans = found.mapInArrow(_merge(min_words), "doc_id long, start_word long, end_word long")
    return spans.withColumn("n_words", F.col("end_word") - F.col("start_word"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
