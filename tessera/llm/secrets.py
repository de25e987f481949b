"""Secret scans over a trigram index.

From each rule's regex a Boolean query over trigrams is derived: what every match must contain. A batch of texts is a
segment of the index: one pass over its bytes collects the postings (text numbers) of all trigrams that some query
names, the query of each rule is evaluated by intersecting and uniting postings, and only the texts that remain are
searched with the regex. Rules without mandatory trigrams scan every text of the segment. Segments are independent, so
nothing is shuffled and no posting list grows with the corpus.

The index folds A-Z; matches are verified on the text as it is, so the query never loses a match.
Null and empty texts have no spans. Spans that tie in their start are ordered by the listing of their kinds; repeated rows stay. A very long
text is a segment of its own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._shared import chunks, doc_id_type, id_text

#: Most strings that an exact or boundary set of a sub-expression may hold before it is given up for a query.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The length of this group must be this at least; shorter matches are dropped.
    group: int = 0
    shortest: int = 0
    base: bool = False
    #: A pattern with the same long matches that skips the short ones faster.
    long_pattern: str | None = None


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True, r"[0-9a-f]{16,}"),
    Rule("codehost", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

ALL, NONE = ("all",), ("none",)


def _both(*qs):
    """AND of queries."""
    parts = {p for q in qs if q != ALL for p in (q[1] if q[0] == "and" else [q])}
    return NONE if NONE in parts else ALL if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _any(*qs):
    """OR of queries."""
    parts = {p for q in qs if q != NONE for p in (q[1] if q[0] == "or" else [q])}
    return ALL if ALL in parts else NONE if not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _holds(strings) -> tuple:
    """What texts that contain one of the strings contain."""
    return _any(*(_both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) if len(s) > 2 else ALL for s in strings))


class _Part:
    """A sub-expression: its strings if they are few, else what its matches begin with, end in and contain."""

    def __init__(self, exact=None, first=frozenset({""}), last=frozenset({""}), query=ALL):
        self.exact, self.first, self.last, self.query = exact, first, last, query

    def opened(self) -> _Part:
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _holds(self.exact))

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return _Part(frozenset(a + b for a in self.exact for b in other.exact))
        cross = lambda x, y: frozenset(a + b for a in x for b in y) if len(x) * len(y) <= MOST else None
        a, b = self.opened(), other.opened()
        seam = cross(self.exact or a.last, other.exact or b.first)
        whole_a = cross(self.exact, b.first) if self.exact is not None else None
        whole_b = cross(a.last, other.exact) if other.exact is not None else None
        return _Part(
            None,
            frozenset(s[:2] for s in whole_a) if whole_a else a.first,
            frozenset(s[-2:] for s in whole_b) if whole_b else b.last,
            _both(a.query, b.query, _holds(seam) if seam else ALL),
        )

    def either(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST:
            return _Part(self.exact | other.exact)
        a, b = self.opened(), other.opened()
        return _Part(None, a.first | b.first, a.last | b.last, _any(a.query, b.query))


_ANYTHING = _Part()
_EMPTY = _Part(frozenset({""}))


def _fold(code: int) -> str | None:
    """Text that the index has for a character; None: it isn't ASCII, so it says nothing."""
    return chr(code).lower() if code < 128 else None


def _sequence(nodes) -> _Part:
    out = _EMPTY
    for op, arg in nodes:
        out = out.then(_part(op, arg))
    return out


def _part(op, arg) -> _Part:
    if op is C.LITERAL:
        c = _fold(arg)
        return _ANYTHING if c is None else _Part(frozenset({c}))
    if op is C.IN:
        chars = set()
        for kind, x in arg:
            span = [x] if kind is C.LITERAL else range(x[0], x[1] + 1) if kind is C.RANGE and x[1] - x[0] < 128 else None
            if span is None or any(_fold(c) is None for c in span):
                return _ANYTHING
            chars |= {_fold(c) for c in span}
        return _Part(frozenset(chars)) if len(chars) <= MOST // 4 else _ANYTHING
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        first, *rest = (_sequence(b) for b in arg[1])
        for x in rest:
            first = first.either(x)
        return first
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, body = arg
        once = _sequence(body)
        if (least, most) == (0, 1):
            return once.either(_EMPTY)
        out = _EMPTY
        for _ in range(min(least, 3)):
            out = out.then(once)
        return out if least == most <= 3 else out.then(_ANYTHING)
    if op is C.AT:
        return _EMPTY
    return _ANYTHING


def trigram_query(pattern: str) -> tuple:
    """("tri", t), ("and" | "or", set of queries), ALL (says nothing) or NONE."""
    return _sequence(P.parse(pattern)).opened().query


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1])) if query[0] in ("and", "or") else set()


class Segment:
    """Postings of the named trigrams in some texts."""

    def __init__(self, texts: list[bytes], trigrams: list[str]):
        self.n = len(texts)
        data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        number = _numbers(tuple(trigrams))
        code = data[:-2].astype(np.uint32) if len(data) > 2 else np.empty(0, np.uint32)
        if len(code):
            code <<= 8
            code |= data[1:-1]
            code <<= 8
            code |= data[2:]
        hit = number[code]
        at = np.flatnonzero(hit)
        text = np.searchsorted(ends, at, "right")
        pairs = np.unique(hit[at].astype(np.int64) * (self.n + 1) + text)
        of, text = np.divmod(pairs, self.n + 1)
        self.postings = {t: text[np.searchsorted(of, k) : np.searchsorted(of, k, "right")] for k, t in enumerate(trigrams, 1)}

    def texts(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.n)
        if query == NONE:
            return np.empty(0, np.int64)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.texts(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


_tables: dict[tuple, np.ndarray] = {}


def _numbers(trigrams: tuple[str, ...]) -> np.ndarray:
    """The number of each of the 2**24 trigrams among those named, else 0."""
    if trigrams not in _tables:
        _tables.clear()
        table = np.zeros(1 << 24, np.uint16 if len(trigrams) > 255 else np.uint8)
        for k, t in enumerate(trigrams, 1):
            a, b, c = t.encode()
            table[a << 16 | b << 8 | c] = k
        _tables[trigrams] = table
    return _tables[trigrams]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (start, kind number, end), in order, in code points, end exclusive; kinds are numbered
    as the rules are listed."""
    queries = [trigram_query(r.pattern) for r in rules]
    named = sorted(set().union(*map(trigrams_of, queries)))
    regexes = [re.compile(r.long_pattern or r.pattern, re.ASCII) for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw = [b or b"" for b in part.column("text").to_pylist()]
                segment = Segment(raw, named)
                spans: list[list] = [[] for _ in raw]
                texts: dict[int, str] = {}
                for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                    for i in segment.texts(query).tolist():
                        if i not in texts:
                            texts[i] = raw[i].decode("utf-8", "replace")
                        for m in regex.finditer(texts[i]):
                            a, b = m.span(rule.group)
                            if b - a >= rule.shortest:
                                spans[i].append((m.start(), k, m.end()))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
                rows = [[{"start": a, "kind": k, "end": b} for a, k, b in sorted(s)] for s in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id {doc_id_type(docs, id_col)}, spans array<struct<start:long,kind:int,end:long>>")

