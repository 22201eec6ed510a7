"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration text."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, id_text, table, tidy

#: Kinds in the order that breaks ties; the method adds `literal`.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: What the lexer stops at: a comment to the line's end or to its close; an element with a value; a target and its assignment sign. A target is a
#: name, an attribute or a quoted key, perhaps with a subscript or a type behind it; names start where no name goes on.
_STOP = re.compile(
    r"""(?:^|(?<=\s))(?P<comment>\#+|//+|--(?=\s))
    |(?P<block>/\*)
    |<(?P<element>[A-Za-z_][\w.-]*)>(?=(?P<body>[^<>\s]+)</(?P=element)>)
    |(?<![\w.$-])(?P<name>[A-Za-z_$][\w.$-]*)(?:\[["'](?P<key>[\w.$-]+)["']\])?["']?[ \t]*(?P<sign>:=|=>|:[ \t]*[A-Za-z_][\w.]*(?:\[[\w., ]*\])?[ \t]*=(?![=>])|=(?![=>])|:(?!:))[ \t]*""",
    re.ASCII | re.MULTILINE | re.VERBOSE,
)
_STRING = re.compile(r"""[rRbBuUfF]{0,2}(?:"(?!"")((?:[^"\\\n]|\\.)*)"|'(?!'')((?:[^'\\\n]|\\.)*)')""")
_TRIPLE = re.compile(r"""[rRbBuUfF]{0,2}(\"{3}|'{3})""")
_PLUS = re.compile(r"""[ \t]*[+.]?[ \t]*(?=[rRbBuUfF]{0,2}["'])""")
#: A bare word is a value only where a line of configuration has nothing else: the target begins the line and the word ends it.
_WORD = re.compile(r"""[^\s"'#;,(){}\[\]<>]*""")
_ENDS = re.compile(r"[ \t]*(?:[;,][ \t]*)?(?:$|[ \t]#|[ \t]//)", re.MULTILINE)
#: Between the literals of a list; an item of a list a line; the lines of a block scalar, behind its sign.
_NEXT = re.compile(r"[\s,\[(]*")
_ITEM = re.compile(r"""\n[ \t]*-[ \t]+(?:(?P<quote>["'])(?P<text>[^"'\n]*)(?P=quote)|(?P<word>[^\s"'#;,(){}\[\]<>]+))[ \t]*(?=$)""", re.MULTILINE)
_SCALAR = re.compile(r"[|>][+-]?[ \t]*(?=\n)")
_LINE = re.compile(r"\n([ \t]*)([^\n]*)")
_ARMOUR = re.compile(r"-----[A-Z ]+-----")
_BEFORE = re.compile(r"[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+|[{,][ \t]*)?[\"']?")
_NAME = re.compile(r"[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*)*", re.ASCII)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")

#: Words of a target's name and what each adds to the score of its literal.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "access": 1.0, "key": 1.5, "signature": 1.0, "salt": 1.0,
}
_PLACEHOLDER = re.compile(r"(?:changeme|example|placeholder|your[-_]|<|\$\{|\{\{|none$|null$|true$|false$|x{4,}|\*{3,})", re.IGNORECASE)
THRESHOLD, SHORTEST = 4.5, 8


def name_score(name: str) -> float:
    words = {w.lower() for w in _CAMEL.split(name) if w}
    words |= {w[:-1] for w in words if w.endswith("s")}  # a list's name is a plural
    return max((SENSITIVE.get(w, 0.0) for w in words), default=0.0) + (1.0 if {"api", "key"} <= words or {"private", "key"} <= words else 0.0)


def literal_score(value: str) -> float:
    """Shape of the literal: bits a character, kinds of characters, length; placeholders and prose score low."""
    if "\n" in value:  # a literal of several lines counts without its breaks and armour
        value = "".join(line.strip() for line in value.splitlines() if not _ARMOUR.fullmatch(line.strip()))
    n = len(value)
    if n < SHORTEST or _PLACEHOLDER.match(value) or re.search(r"\s", value):
        return -9.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(bits / 2, 2.0) + 0.5 * (kinds - 1) + (0.5 if n >= 16 else 0.0)


class _Lexer:
    """One text's tokens, read once from left to right; every comment is a scope of its own.

    Places of closing marks are listed once, a word's end is looked for once, and constants that go out of scope are found
    by their indent in a heap, so that time is in proportion to the text (but for logarithms).
    """

    def __init__(self, text: str):
        self.text = text
        self.closers: dict[str, list[int]] = {'"' * 3: [], "'" * 3: [], "*/": []}
        for m in re.finditer(r"\"{3}|'{3}|\*/", text):
            self.closers[m[0]].append(m.start())
        self.found: dict[tuple[int, int], float] = {}
        self.word_end, self.word_ends_line = -1, False

    def scan(self) -> dict[tuple[int, int], float]:
        scopes = [(0, len(self.text), False)]
        while scopes:
            scopes.extend(self._scope(*scopes.pop()))
        return self.found

    def _close(self, mark: str, at: int, end: int) -> int:
        """Where `mark` next stands, -1 if not before `end`."""
        places = self.closers[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) and places[k] < end else -1

    def _reach(self, name: str, literal: tuple[str, int, int]) -> None:
        value, start, end = literal
        rank = name_score(name)
        if rank and (score := rank + literal_score(value)) >= THRESHOLD:
            self.found[start, end] = max(score, self.found.get((start, end), score))

    def _value(self, at: int, stop: int) -> tuple[str, int, int] | None:
        """The string literal at `at`, joined with those added to it: (value, start, end); quotes within count, one part alone has none."""
        text, parts, start, end = self.text, [], -1, at
        while True:
            if m := _TRIPLE.match(text, at, stop):
                close = self._close(m[1], m.end(), stop)
                if close < 0:
                    break
                inner = text[m.end() : close]
                first, past = m.end() + len(inner) - len(inner.lstrip()), m.end() + len(inner.rstrip())
                part, after = inner.strip(), close + 3
            elif m := _STRING.match(text, at, stop):
                group = 1 if m[1] is not None else 2
                part, first, past, after = m[group], m.start(group), m.end(group), m.end()
            else:
                break
            parts.append(part)
            start, end = first if start < 0 else start, max(past, first) if start < 0 else after
            if not (more := _PLUS.match(text, after, stop)):
                break
            at = more.end()
        return ("".join(parts), start, end) if start >= 0 else None

    def _bare(self, at: int, end: int) -> int:
        """Where the word at `at` ends if it ends its line, else -1."""
        if at >= self.word_end:
            self.word_end = _WORD.match(self.text, at, end).end()
            self.word_ends_line = bool(_ENDS.match(self.text, self.word_end, end))
        return self.word_end if self.word_ends_line and at < self.word_end else -1

    def _listed(self, at: int, end: int, sign: str) -> Iterator[tuple[str, int, int]]:
        """Literals of a list in brackets, items of a list a line, or a block scalar, where one of these is the value at `at`."""
        text = self.text
        if text[at : at + 1] in ("[", "("):
            while literal := self._value(at := _NEXT.match(text, at, end).end(), end):
                yield literal
                at = max(literal[2], at) + 1
                if text[at - 1 : at] not in ("'", '"', ","):
                    return
        elif sign == ":" and text[at : at + 1] == "\n":
            while m := _ITEM.match(text, at, end):
                group = "text" if m["quote"] else "word"
                yield m[group], m.start(group), m.end(group)
                at = m.end()
        elif sign == ":" and (m := _SCALAR.match(text, at, end)):
            line = text.rfind("\n", max(0, at - 400), at) + 1
            own, lines, start, past = len(text[line:at]) - len(text[line:at].lstrip()), [], -1, m.end()
            while (m := _LINE.match(text, past, end)) and (len(m[1]) > own or not m[2].strip()):
                lines.append(m[2].strip())
                start, past = m.start(2) if start < 0 else start, m.end()
            if start >= 0:
                yield "\n".join(lines), start, start + len(text[start:past].rstrip())

    def _scope(self, at: int, end: int, one_line: bool) -> list[tuple[int, int, bool]]:
        """Reads text[at:end]; returns the comments in it. Constants reach targets until a line that is indented less than their own."""
        text, comments, line = self.text, [], at
        known: dict[str, tuple[int, tuple[str, int, int]]] = {}
        by_indent: list[tuple[int, str]] = []
        line = text.rfind("\n", 0, at) + 1 if not one_line and at == 0 else at
        self.word_end = -1
        seen = at
        while m := _STOP.search(text, at, end):
            at = m.end()
            if m["comment"]:
                close = end if one_line else text.find("\n", at, end)
                close = end if close < 0 else close
                comments.append((at, close, True))
                at = close
                continue
            if m["block"]:
                if (close := self._close("*/", at, end)) >= 0:
                    comments.append((at, close, False))
                    at = close + 2
                continue
            if m["element"]:
                self._reach(m["element"], (m["body"], at, at + len(m["body"])))
                continue
            if (broken := text.rfind("\n", seen, m.start())) >= 0:
                line = broken + 1
            seen = m.start()
            before = text[line : m.start()] if m.start() - line < 200 else "x"
            indent = len(before) - len(before.lstrip())
            if not before or before.isspace():
                while by_indent and -by_indent[0][0] > indent:
                    gone = heapq.heappop(by_indent)[1]
                    if gone in known and known[gone][0] > indent:
                        del known[gone]
            literal = self._value(at, end)
            if literal is None and (past := self._bare(at, end)) >= 0:
                name = _NAME.match(text, at, past)
                word = name[0] if name and name.end() == past else None
                if word in known:
                    literal = known[word][1]  # the target takes a constant's literal
                elif _BEFORE.fullmatch(before) and not (word and "." in word) and not _SCALAR.match(text, at, end):
                    literal = text[at:past], at, past
            elif literal is None and (name := _NAME.match(text, at, end)) and name[0] in known and text[name.end() : min(name.end() + 1, end)] in ("", "\n", " ", ",", ")", ";"):
                literal = known[name[0]][1]
            target = m["key"] or m["name"]
            if literal:
                known[m["name"]] = indent, literal
                heapq.heappush(by_indent, (-indent, m["name"]))
                self._reach(target, literal)
                at = max(at, literal[2])
            elif name_score(target):
                for item in self._listed(at, end, m["sign"]):
                    self._reach(target, item)
        return comments


def literals(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of literals that reach a sensitive name: directly, joined from parts, in a list, or through constants.

    Only string literals count, and in lines of configuration and in elements bare words; names, calls, attributes and
    subscripts on the right are no literals. A constant reaches targets until a line that is indented less than its own; what is
    in a comment reaches no code. The score adds the target's name and the literal's shape.
    """
    return [("literal", *span, score) for span, score in _Lexer(text).scan().items()]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _join(spans: list[tuple[str, int, int]]) -> str:
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "<SECRET>") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan(text: str) -> tuple[list, list]:
    """(base spans, spans the lexer adds with their scores); offsets are code points, ends exclusive."""
    return base_spans(text), literals(text) if "=" in text or ":" in text or "</" in text else []


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans; one row for each row of `docs`, map-only.

    `literal_scores` are those of the literal spans, in their order. Null and empty texts have no spans; repeated rows are
    scanned each; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    base, more = scan(text)
                    kinds = Counter(s[0] for s in base)
                    digest = hashlib.sha256(_join(base).encode()).hexdigest()
                    scores = [round(score, 3) for *_, score in sorted(more, key=lambda x: x[1:3])]
                    rows.append((kinds["assign"], kinds["access"], kinds["hex"], digest, _join(base + [x[:3] for x in more]), scores))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.float64())]
                yield pa.record_batch(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "literal_scores"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, literal_scores array<double>")


def redact_secrets(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """`docs` with every span replaced in `text`, and n_chars, where there is one, counted again. Null texts stay null."""

    names, schema = docs.columns, docs.schema

    @tidy
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch):
                texts = [t if t is None else redact(t, [s[:3] for found in scan(t) for s in found], mark) for t in part.column("text").to_pylist()]
                columns = dict(zip(names, part.columns, strict=True))
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                yield pa.record_batch(list(columns.values()), names)

    return docs.mapInArrow(run, schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
