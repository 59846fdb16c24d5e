"""Secret scan by a trigram index: each regex gives a Boolean query over trigrams, whose candidates are verified.

The trigrams that every match of a regex must hold are read off its parse tree as alternatives of
sets: a text is a candidate if it holds all trigrams of one alternative.  A rule whose matches need no
trigram (runs of hex digits) scans all texts.  The index is built in segments, one for each Arrow
batch of rows: the postings of each query trigram over the rows of the segment.  Queries intersect and
unite postings; only candidates meet the regex.  Segments are independent, so nothing is shuffled and
a lost task repeats its own rows alone.

Letters are folded in the index, so candidates of case-sensitive rules are a superset too.  Spans are
in code points of the whole text, end exclusive.

Defined results: null and empty texts have no spans; each row, repeated or not, has its own; the text column goes, one
named ``spans`` is replaced, all others stay, whatever their names; null ids are kept; very long texts are scanned whole; spans
that start together go by the order of the rules; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.llm.common import ROW, TEXT, Batches, carried, uncarried, utf8, with_row

# strings that a run of a regex may stand for before it is cut, and alternatives of a query
_MOST = 64
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches shorter than ``least`` (of ``group``) are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The rules.  The first three are the base kinds.
ASSIGN = Rule(
    "assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 20)
# runs of 24 and more are the same as the runs of any length that have 24
HEX = Rule("hex", r"[0-9a-f]{24,}", 24)
BASE = (ASSIGN, ACCESS, HEX)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)

Query = tuple[frozenset[bytes], ...]
_ANYTHING: Query = (frozenset(),)


def _folded(code: int) -> str:
    char = chr(code)
    return char.lower() if char.isascii() else char


def _choices(items: Iterable) -> set[str] | None:
    """The characters of a class if it is a short list."""
    found: set[str] = set()
    for kind, value in items:
        if kind is not sre.LITERAL:
            return None
        found.add(_folded(value))
    return found if len(found) <= 8 else None


def _strings(node) -> set[str] | None:
    """All folded strings that a part of a regex can stand for, if they are few."""
    kind, value = node
    if kind is sre.LITERAL:
        return {_folded(value)}
    if kind is sre.IN:
        return _choices(value)
    if kind is sre.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is sre.BRANCH:
        parts = [_sequence_strings(branch) for branch in value[1]]
        return None if None in parts else _few(set().union(*parts))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        if (least, most) == (0, 1):
            own = _sequence_strings(inner)
            return None if own is None else own | {""}
        if least == most and most <= 8:
            return _sequence_strings(list(inner) * least)
    return None


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= _MOST else None


def _sequence_strings(nodes) -> set[str] | None:
    found: set[str] | None = {""}
    for node in nodes:
        own = _strings(node)
        if own is None or found is None:
            return None
        found = _few({a + b for a in found for b in own})
    return found


def _trigrams(text: str) -> frozenset[bytes]:
    data = text.encode()
    return frozenset(data[i:i + 3] for i in range(len(data) - 2))


def _simplest(query: Iterable[frozenset[bytes]]) -> Query:
    """Without alternatives that hold all of another one's trigrams."""
    kept: list[frozenset[bytes]] = []
    for own in sorted(set(query), key=len):
        if not any(other <= own for other in kept):
            kept.append(own)
    return tuple(kept)


def _both(a: Query, b: Query) -> Query:
    joined = _simplest(x | y for x in a for y in b)
    # one side alone is a wider query, so no match is lost
    return joined if len(joined) <= _MOST else max(a, b, key=lambda q: min(len(x) for x in q))


def _sequence_query(nodes) -> Query:
    query, run = _ANYTHING, {""}
    for node in nodes:
        own = _strings(node)
        grown = None if own is None else _few({a + b for a in run for b in own})
        if grown is not None:
            run = grown
            continue
        if own is None and node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            # the copies that must be there go on with the run
            least = _sequence_strings(list(node[1][2]) * min(node[1][0], 8))
            run = (least and _few({a + b for a in run for b in least})) or run
        query = _both(query, _simplest(map(_trigrams, run)))
        run = own if own is not None else {""}
        if own is None:
            query = _both(query, _node_query(node))
    return _both(query, _simplest(map(_trigrams, run)))


def _node_query(node) -> Query:
    kind, value = node
    if kind is sre.SUBPATTERN:
        return _sequence_query(value[-1])
    if kind is sre.BRANCH:
        return _simplest(alternative for branch in value[1] for alternative in _sequence_query(branch))
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
        return _sequence_query(value[2])
    return _ANYTHING


def trigram_query(pattern: str) -> Query:
    """Sets of folded trigrams; a text without all trigrams of at least one set has no match."""
    return _sequence_query(_parser.parse(pattern))


class Segment:
    """Postings of the query trigrams over the texts of one batch, a row of flags for each trigram."""

    def __init__(self, grams: Sequence[bytes], number: np.ndarray, texts: Sequence[bytes]):
        self.row = {gram: i + 1 for i, gram in enumerate(grams)}
        self.postings = np.zeros((len(grams) + 1, len(texts)), bool)
        for at, text in enumerate(texts):
            data = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
            for start in range(0, max(len(data) - 2, 0), _CHUNK):
                part = data[start:start + _CHUNK + 2]
                self.postings[number[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]], at] = True

    def candidates(self, query: Query) -> np.ndarray:
        found = np.zeros(self.postings.shape[1], bool)
        for alternative in query:
            rows = [self.row[gram] for gram in alternative]
            found |= self.postings[rows].all(axis=0) if rows else True
        return found


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> Iterator[tuple[int, int]]:
    for match in compiled.finditer(text):
        if match.end(rule.group) - match.start(rule.group) >= rule.least:
            yield match.span()


def _scan(rules: Sequence[Rule]):
    def scanned(batches: Batches) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(rule.pattern) for rule in rules]
        compiled = [re.compile(rule.pattern) for rule in rules]
        grams = sorted({gram for query in queries for own in query for gram in own})
        number = np.zeros(1 << 24, np.uint16)
        for i, gram in enumerate(grams):
            number[int.from_bytes(gram, "big")] = i + 1
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = utf8(batch.column("__text"))
            segment, found = Segment(grams, number, texts), [[] for _ in texts]
            for order, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                for at in np.flatnonzero(segment.candidates(query)):
                    found[at].extend((start, order, end) for start, end in spans_of(texts[at].decode(), rule, pattern))
            spans = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(spans, pa.list_(span))], ["__row", "spans"])
    return scanned


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns but the text, and ``spans`` by start, then by the order of the rules."""
    rows = carried(docs, id_col, text_col)
    found = rows.select(ROW, TEXT).mapInArrow(
        _scan(rules), with_row(rows, "spans array<struct<kind:string,start:bigint,end:bigint>>"))
    return uncarried(found, docs.drop(text_col), text_col, F.lit(None), {"spans": F.col("spans")})
