"""Exact encoding with public tokenizers, faster for repeated words.

A text is cut at places no token can cross, each distinct part is encoded once by the library
(`encode_batch`, batches balanced by bytes), and the ids of a text are the parts' ids in order. Parts are
split, and distinct ones found, by Arrow for a batch of texts at once; a text's ids are then gathered by number.
Where a tokenizer's file doesn't show such places, whole texts are encoded.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold

#: Parts remembered by a worker, bytes of parts given to the library at once, characters split at once.
MEMO, ENCODE_BYTES, SEGMENT = 300_000, 1 << 17, 1 << 20
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_BLANK = re.compile(r"[ \t\r\n]")
#: What may follow a word's letters without a token crossing.
_TAIL = ".,;:!?"


class PartEncoder:
    """encode_all(texts) gives the ids of whole texts and where each text's ids end."""

    def __init__(self, path: str):
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.bar: int | None = None
        self.closing: np.ndarray | None = None
        self.before = pa.array([], pa.string()), _Ids(np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (own.id_to_piece(i) for i in range(own.get_piece_size()))
            crossing = any("▁" in p.lstrip("▁") for p in pieces)
            self.cut = "whole" if crossing or own.encode("a b") != own.encode("a") + own.encode("b") else "drop"
            self.encode = lambda texts: own.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_padding()
            own.no_truncation()
            batch = getattr(own, "encode_batch_fast", own.encode_batch)
            spec = json.loads(own.to_str())
            self.cut = _safe_cut(spec)
            self.encode = lambda texts: [e.ids for e in batch(texts, add_special_tokens=False)]
            if self.cut == "space" and len(bar := self.encode(["|"])[0]) == 1:
                self.bar = bar[0]
                if suffix := spec["model"].get("end_of_word_suffix"):
                    self.closing = np.zeros(own.get_vocab_size(), bool)
                    self.closing[[i for token, i in own.get_vocab().items() if token.endswith(suffix)]] = True

    def _parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Every part of all texts, and how many parts each text has."""
        if self.cut != "space":
            cut = {"whole": lambda t: [t] if t else [], "keep": _BEFORE_SPACE.split, "drop": _drop_space}[self.cut]
            parts = [cut(t) for t in texts]
            return pa.array([p for found in parts for p in found], pa.string()), np.array([len(p) for p in parts])
        pieces, owners = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > SEGMENT and (blank := _BLANK.search(text, at + SEGMENT)):
                pieces.append(text[at : blank.start()])
                owners.append(i)
                at = blank.start()
            pieces.append(text[at:] if at else text)
            owners.append(i)
        whole = pa.array(pieces, pa.string())
        # The tokenizer lower-cases, so either case of A-Z gives the same ids; special strings are told apart by case.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
        sizes = np.bincount(owners, pc.list_value_length(lists).to_numpy(zero_copy_only=False), len(texts))
        return lists.flatten(), sizes.astype(np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, as uint32; how many ids each text has). Give a few MB of text at once."""
        codes, known, sizes = self._coded(texts)
        each = known.lengths[codes]
        return known.gather(codes), _per_text(each, sizes)

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        codes, known, sizes = self._coded(texts)
        return _per_text(known.lengths[codes], sizes)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        ids, sizes = self.encode_all(texts)
        raw, ends = ids.astype("<u4", copy=False).tobytes(), np.cumsum(sizes) * 4
        return [raw[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)] if len(texts) else []

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, _Ids, np.ndarray]:
        """For every part a number, the ids of each number, and the parts of each text."""
        parts, sizes = self._parts(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        known = self._ids_of_parts(distinct) if self.closing is not None else _Ids.of(self._lookup(distinct.to_pylist()))
        return coded.indices.to_numpy(zero_copy_only=False), known, sizes

    def _ids_of_parts(self, distinct: pa.Array) -> _Ids:
        """Letters and the punctuation after them are never in one token, so a part is a word and a tail, each encoded once.

        Words are remembered; when they are too many, those of the last batch.
        """
        core = pc.utf8_rtrim(distinct, characters=_TAIL)
        is_word = pc.utf8_is_alpha(core)
        words = core.filter(is_word).dictionary_encode()
        tails = pc.replace_substring_regex(distinct.filter(is_word), f"^[^{_TAIL}]+", "").dictionary_encode()
        others = distinct.filter(pc.invert(is_word))
        units = [self._words(words.dictionary), self._others(tails.dictionary), self._others(others)]
        first, second = np.empty(len(distinct), np.int64), np.full(len(distinct), -1, np.int64)
        mask = is_word.to_numpy(zero_copy_only=False)
        n, m = len(words.dictionary), len(tails.dictionary)
        first[mask], second[mask] = words.indices.to_numpy(zero_copy_only=False), n + tails.indices.to_numpy(zero_copy_only=False)
        first[~mask] = n + m + np.arange(len(others))
        every = _Ids(np.concatenate([u.flat for u in units]), np.concatenate([*(u.lengths for u in units), [0]]))  # the last unit is empty
        both = np.stack([first, second], 1)
        return _Ids(every.gather(both.ravel()), every.lengths[both].sum(1))

    def _words(self, words: pa.Array) -> _Ids:
        seen, ids = self.before
        at = pc.index_in(words, seen).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(pa.array(at < 0))
        learned = _Ids.join([self._run_of_words(run) for run in _runs(new)])
        at[at < 0] = len(seen) + np.arange(len(new))
        both = _Ids.join([ids, learned])
        found = _Ids(both.gather(at), both.lengths[at])
        self.before = (pa.concat_arrays([seen, new]), both) if len(both.lengths) <= MEMO else (words, found)
        return found

    def _run_of_words(self, run: list[str]) -> _Ids:
        """In one text for the whole run, as each such word ends with the only closing token it has."""
        ids = np.asarray(self.encode([" ".join(run)])[0], "<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        return _Ids(ids, np.diff(ends, prepend=0)) if len(ends) == len(run) and ends[-1] == len(ids) else self._one_by_one(run)

    def _others(self, parts: pa.Array) -> _Ids:
        """In one text for each run, with a part that has one id of its own between the parts; parts that hold it alone."""
        return _Ids.join([self._run_of_others(run) for run in _runs(parts)])

    def _run_of_others(self, run: list[str]) -> _Ids:
        if self.bar is None or any("|" in p or not p for p in run):
            return self._one_by_one(run)
        ids = np.asarray(self.encode([" | ".join(run)])[0], "<u4")
        is_bar = ids == self.bar
        ends = np.append(np.flatnonzero(is_bar), len(ids))
        return _Ids(ids[~is_bar], np.diff(ends, prepend=-1) - 1) if len(ends) == len(run) else self._one_by_one(run)

    def _one_by_one(self, run: list[str]) -> _Ids:
        return _Ids.of([np.asarray(i, "<u4").tobytes() for i in self.encode(run)])

    def _lookup(self, distinct: list[str]) -> list[bytes]:
        """The ids of each part; parts not remembered are encoded. Parts not met for long are forgotten."""
        if len(self.fresh) > MEMO // 2:
            self.aged, self.fresh = self.fresh, {}
        out = self._remembered(distinct)
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing:
            self._learn([distinct[i] for i in missing])
            for i in missing:
                out[i] = self.fresh[distinct[i]]
        return out

    def _remembered(self, parts: list[str]) -> list[bytes | None]:
        fresh, aged = self.fresh, self.aged
        out = list(map(fresh.get, parts))
        if aged:
            for i, ids in enumerate(out):
                if ids is None and (ids := aged.get(parts[i])) is not None:
                    out[i] = fresh[parts[i]] = ids
        return out

    def _learn(self, parts: list[str]) -> None:
        self._by_bytes(parts, self._encode)

    def _by_bytes(self, parts: list[str], encode) -> None:
        run, size = [], 0
        for part in parts:
            run.append(part)
            size += len(part)
            if size > ENCODE_BYTES:
                encode(run)
                run, size = [], 0
        encode(run)

    def _encode(self, run: list[str]) -> None:
        if run:
            self.fresh.update(zip(run, (np.asarray(i, "<u4").tobytes() for i in self.encode(run)), strict=True))


class _Ids:
    """Ids of numbered parts: all in a row, and how many each part has."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths

    @classmethod
    def of(cls, parts: list[bytes]) -> _Ids:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    @classmethod
    def join(cls, several: list[_Ids]) -> _Ids:
        return cls(np.concatenate([np.zeros(0, "<u4"), *(x.flat for x in several)]), np.concatenate([np.zeros(0, np.int64), *(x.lengths for x in several)]))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of parts in the order of `codes`."""
        each = self.lengths[codes]
        if not len(each):
            return np.zeros(0, "<u4")
        starts, ends = np.cumsum(self.lengths) - self.lengths, np.cumsum(each)
        at = np.repeat((starts[codes] - (ends - each)).astype(np.int32), each)
        return self.flat[np.add(at, np.arange(len(at), dtype=np.int32), out=at)]


def _runs(parts: pa.Array) -> Iterator[list[str]]:
    """Runs of parts of about ENCODE_BYTES; parts that hold a bar, or nothing, are runs of their own kind."""
    alone = pc.or_(pc.match_substring(parts, "|"), pc.equal(pc.binary_length(parts), 0))
    if not pc.any(alone).as_py():
        ends = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False)) // ENCODE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(parts)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield parts.slice(a, b - a).to_pylist()
        return
    kinds = alone.to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(parts)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if kinds[a]:
            yield parts.slice(a, b - a).to_pylist()
        else:
            yield from _runs(parts.slice(a, b - a))


def _per_text(each: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of `sizes` values, none for empty ones."""
    sums = np.concatenate([[0], np.cumsum(each)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _drop_space(text: str) -> list[str]:
    return [p if i == 0 else p[1:] for i, p in enumerate(_BEFORE_SPACE.split(text))] if text else []


def _safe_cut(spec: dict) -> str:
    """space: white space is dropped before splitting; keep: a word keeps the one space before it; else whole."""

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if not x else x[inner] if x["type"] == "Sequence" else [x]

    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    norm, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    if not plain or any(re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        return "whole"
    blank = any(n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm)
    kinds = {n["type"] for n in norm}
    marked = all(t["content"].startswith("<|") for t in spec["added_tokens"])
    if blank and marked and "Lowercase" in kinds and kinds <= {"NFC", "Replace", "Lowercase"} and pre and pre[0]["type"] == "Split":
        pattern = pre[0]["pattern"].get("Regex", "")
        if pre[0]["behavior"] == "Removed" and pre[0]["invert"] and r"[^\s\p{L}\p{N}]+" in pattern and r"|[\p{L}]+|" in pattern:
            return "space"
    if not norm and [p["type"] for p in pre] == ["ByteLevel"] and pre[0].get("use_regex", True) and not pre[0]["add_prefix_space"]:
        return "keep"
    return "whole"


def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process, so that what it remembers serves all its tasks."""
    hold("tokenizing", _encoder.cache_clear)
    return _encoder(path)


@functools.cache
def _encoder(path: str) -> PartEncoder:
    return PartEncoder(path)
