"""Secret scans through a trigram inverted index.

Every block of documents gets an inverted index from trigrams to documents.  A Boolean
trigram query is derived from each rule's regular expression; its postings are
intersected and united, and only the documents that remain are searched with the
expression itself.  A rule whose expression has no mandatory trigram searches every
document.  The index folds A-Z to a-z, which admits more candidates and loses none;
postings are held only for trigrams that some rule asks for.

Null and empty texts have no spans.  Spans are in code points with an exclusive end and
are ordered by start, then by kind as the rules are listed.  Rows are independent, so
repeated rows and ids that tie repeat their answer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrays import LOWER, text_blocks

_parser = re._parser
#: A regular expression may expand to so many literal strings before it is cut.
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` for which ``group`` has ``least`` characters.

    ``search`` may be a pattern that finds the very matches that pass, faster.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    search: str | None = None
    base: bool = False


BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, base=True),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}", base=True),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE

# A trigram query: None (every document), a trigram, ("and", ...) or ("or", ...).
Query = None | str | tuple


def _both(parts: Iterable[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _either(parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: Iterable[str]) -> Query:
    """What holds if one of the strings occurs."""
    return _either(_both(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is _parser.LITERAL:
            out.add(chr(value))
        elif op is _parser.RANGE and value[1] - value[0] < 8:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tokens: Iterable) -> tuple[set[str] | None, Query]:
    """The exact strings that a sequence can match, or None, and its query."""
    held: set[str] = {""}
    found: list[Query] = []
    exact = True
    for op, value in tokens:
        own, query = _one(op, value)
        if own is not None and len({a + b for a in held for b in own}) <= _MOST_STRINGS:
            held = {a + b for a in held for b in own}
            continue
        exact = False
        found += [_of_strings(held), query if own is None else None]
        held = own if own is not None else {""}
    if exact:
        return held, None
    return None, _both([*found, _of_strings(held)])


def _one(op, value) -> tuple[set[str] | None, Query]:
    p = _parser
    if op is p.LITERAL:
        return {chr(value).lower()}, None
    if op is p.IN:
        members = _members(value)
        return (None if members is None else {m.lower() for m in members}), None
    if op is p.SUBPATTERN:
        return _walk(value[3])
    if op is p.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        return None, _either(q if s is None else _of_strings(s) for s, q in parts)
    if op in (p.MAX_REPEAT, p.MIN_REPEAT):
        least, most, inner = value
        strings, query = _walk(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if strings is not None and least == most <= 8 and len(strings) == 1:
            return {next(iter(strings)) * least}, None
        return None, (query if strings is None else _of_strings(strings)) if least else None
    if op is p.AT:
        return {""}, None
    return None, None


@lru_cache(maxsize=64)
def trigram_query(pattern: str) -> Query:
    """A Boolean query that every text with a match of ``pattern`` satisfies."""
    strings, query = _walk(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


class TrigramIndex:
    """Postings (sorted row numbers) of a block of texts for the trigrams asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, trigrams: Iterable[str]):
        codes = {t: int.from_bytes(t.encode("latin-1"), "big") for t in trigrams if max(map(ord, t)) < 128}
        self._all = np.arange(len(offsets) - 1)
        wanted = np.sort(np.array(list(codes.values()), dtype=np.int32))
        asked = np.zeros(1 << 24, dtype=bool) if len(wanted) else None
        low = LOWER[data].astype(np.int32)
        grams = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else low[:0]
        if asked is None:
            at = np.zeros(0, np.int64)
        else:
            asked[wanted] = True
            at = np.flatnonzero(asked[grams])
        row = np.searchsorted(offsets, at, side="right") - 1
        ends = offsets[row + 1]
        at, row = at[at + 3 <= ends], row[at + 3 <= ends]
        found = np.unique(grams[at].astype(np.int64) << 32 | row)
        cuts = {c: np.searchsorted(found, [c << 32, (c + 1) << 32]) for c in codes.values()}
        self._postings = {t: found[cuts[c][0] : cuts[c][1]] & 0xFFFFFFFF for t, c in codes.items()}

    def rows(self, query: Query) -> np.ndarray:
        if query is None:
            return self._all
        if isinstance(query, str):
            return self._postings.get(query, self._all)
        parts = [self.rows(q) for q in query[1:]]
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out


def matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough."""
    if rule.search:
        return [m.span() for m in _compiled(rule.search).finditer(text)]
    return [m.span() for m in _compiled(rule.pattern).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


@lru_cache(maxsize=64)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def scan_block(texts: list[str], data: np.ndarray, offsets: np.ndarray, rules: list[Rule]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every span, in order, for each text of a block."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(data, offsets, set().union(*map(_trigrams, queries)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for row in index.rows(query):
            out[row] += [(start, k, end) for start, end in matches(rule, texts[row])]
    return [sorted(x) for x in out]


def _scan(docs: DataFrame, text_col: str, rules: list[Rule], kept: list[str], fields: list[T.StructField], make: Callable) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    wanted = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(wanted.index(text_col))
            for first, end, data, offsets in text_blocks(column):
                texts = [x or "" for x in column.slice(first, end - first).to_pylist()]
                spans = scan_block(texts, data, offsets, rules)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(make(part, texts, spans), names=schema.names)

    return docs.select(*wanted).mapInArrow(run, schema)


def _listed(spans: Iterable[tuple[int, int, int]], rules: list[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: id, ``n_<kind>`` of each base rule, ``base_sha256`` and ``spans``.

    ``spans`` has kind:start:end of all rules, comma-joined ('' if none); ``base_sha256``
    is the SHA-256 of the same list for the base rules alone.
    """
    rules = rules or RULES
    base = [k for k, r in enumerate(rules) if r.base]
    fields = [T.StructField(f"n_{rules[k].kind}", T.LongType()) for k in base]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make(part: pa.RecordBatch, _: list[str], spans: list) -> list[pa.Array]:
        counts = [pa.array([sum(x[1] == k for x in own) for own in spans], pa.int64()) for k in base]
        digests = [hashlib.sha256(_listed((x for x in own if rules[x[1]].base), rules).encode()).hexdigest() for own in spans]
        return [part.column(0), *counts, pa.array(digests, pa.string()), pa.array([_listed(own, rules) for own in spans], pa.string())]

    return _scan(docs, text_col, rules, [id_col], fields, make)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with every span (overlapping ones united) replaced by ``[<kind>]`` of its first rule.

    The length column, if there is one, is set to the new text's code points for texts
    that changed; null texts stay null.
    """
    rules = rules or RULES
    names = docs.columns

    def make(part: pa.RecordBatch, texts: list[str], spans: list) -> list[pa.Array]:
        new = [_replaced(text, own, rules) if own else None for text, own in zip(texts, spans, strict=True)]
        out = []
        for i, name in enumerate(names):
            column = part.column(i)
            if any(x is not None for x in new) and name in (text_col, length_col):
                was = column.to_pylist()
                column = pa.array([(n if name == text_col else len(n)) if n is not None else w for n, w in zip(new, was, strict=True)], column.type)
            out.append(column)
        return out

    return _scan(docs, text_col, rules, names, [], make)


def _replaced(text: str, spans: list[tuple[int, int, int]], rules: list[Rule]) -> str:
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{rules[k].kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
