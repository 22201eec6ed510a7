"""Hashes of words and of runs of words, for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = 0x9E3779B97F4A7C15


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, how many words each text has).

    Words are runs without ASCII white space, A-Z lower-cased; each distinct word of the batch is hashed once. A null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in distinct:  # what is before a text's first blank or after its last one
        real = codes != distinct.index(b"")
        sums = np.append(0, np.cumsum(real))
        ends = np.cumsum(sizes)
        codes, sizes = codes[real], sums[ends] - sums[ends - sizes]
    return h[codes], sizes


def by_text(values: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    for n in sizes.tolist():
        yield values[at : at + n]
        at += n


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row, by doubling."""
    n, out, done, span = len(h) - size + 1, None, 0, 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if size & span:
            if out is None:
                out, done = h, span
            else:
                keep = min(len(out), len(h) - done)
                out, done = out[:keep] * np.uint64(pow(_BASE, span, 1 << 64)) + h[done : done + keep], done + span
        if done == size:
            break
        h = h[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + h[span:]
        span *= 2
    out = out[:n] ^ (out[:n] >> np.uint64(31))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run, one without words has none."""
    return np.unique(runs(h, min(size, len(h)))) if len(h) else h
