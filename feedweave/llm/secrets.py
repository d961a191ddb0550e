"""Secret scans through a trigram inverted index.

Each rule is a regular expression.  From its parse tree a Boolean query of trigrams
is derived that every match must satisfy.  The documents of a segment (a bounded
slice of a partition's rows) get an inverted index whose postings are intersected
and united as the query says; only the candidates are then matched against the
expression.  A rule without mandatory trigrams matches against every document.
Segments are indexed where their rows are, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedweave.llm import text as tx

#: Alternatives of a query beyond which its part is taken to be any text.
MOST_STRINGS = 64


# Queries: True (any text), a trigram, ("and", parts) or ("or", parts).


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    parts = {*(a[1] if a[0] == "and" else [a]), *(b[1] if b[0] == "and" else [b])}
    return ("and", frozenset(parts)) if len(parts) > 1 else next(iter(parts))


def either(a, b):
    if a is True or b is True:
        return True
    parts = {*(a[1] if a[0] == "or" else [a]), *(b[1] if b[0] == "or" else [b])}
    return ("or", frozenset(parts)) if len(parts) > 1 else next(iter(parts))


def of_string(s: bytes):
    out = True
    for i in range(len(s) - 2):
        out = both(out, ("gram", s[i : i + 3]))
    return out


def of_strings(strings):
    out = None
    for s in sorted(strings):
        out = of_string(s) if out is None else either(out, of_string(s))
    return True if out is None else out


@dataclass
class Part:
    """What is known of a piece of an expression: all its strings, if they are few, or
    else the strings it can begin and end with, and the query its matches satisfy."""

    exact: frozenset | None
    head: frozenset
    tail: frozenset
    query: object = True


_EMPTY = Part(frozenset([b""]), frozenset([b""]), frozenset([b""]))
_ANY = Part(None, frozenset([b""]), frozenset([b""]))


def _cross(a, b):
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else None


def _exact(strings) -> Part:
    return Part(frozenset(strings), frozenset(strings), frozenset(strings))


def _join(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and (all_of := _cross(a.exact, b.exact)) is not None:
        return _exact(all_of)
    query = both(_known(a), _known(b))
    middle = _cross(a.tail, b.head)
    if middle is not None:
        query = both(query, of_strings(middle))
    head, tail = a.head, b.tail
    if a.exact is not None and (longer := _cross(a.exact, b.head)) is not None:
        head = longer
    if b.exact is not None and (longer := _cross(a.tail, b.exact)) is not None:
        tail = longer
    return Part(None, frozenset(x[:8] for x in head), frozenset(x[-8:] for x in tail), query)


def _known(p: Part):
    return both(p.query, of_strings(p.exact)) if p.exact is not None else both(p.query, both(of_strings(p.head), of_strings(p.tail)))


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return _exact(a.exact | b.exact)
    query = either(_known(a), _known(b))
    head, tail = a.head | b.head, a.tail | b.tail
    short = lambda x: x if len(x) <= MOST_STRINGS else frozenset([b""])
    return Part(None, short(head), short(tail), query)


def _class(items) -> Part:
    chars = set()
    for kind, value in items:
        if kind is C.LITERAL:
            chars.add(value)
        elif kind is C.RANGE:
            chars.update(range(value[0], min(value[1] + 1, value[0] + 300)))
        else:
            return _ANY
    folded = {_fold(chr(c)) for c in chars}
    return _exact(folded) if len(folded) <= 8 else _ANY


def _fold(s: str) -> bytes:
    return s.encode("utf-8").lower()


def _walk(tree) -> Part:
    out = _EMPTY
    for op, value in tree:
        if op is C.LITERAL:
            part = _exact([_fold(chr(value))])
        elif op is C.IN:
            part = _class(value) if value[0][0] is not C.NEGATE else _ANY
        elif op is C.SUBPATTERN:
            part = _walk(value[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in value[1]]
            part = parts[0]
            for p in parts[1:]:
                part = _either(part, p)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            one = _walk(inner)
            if least == 0:
                part = _either(one, _EMPTY) if most == 1 else _ANY
            else:
                part = one
                for _ in range(min(least, 8) - 1):
                    part = _join(part, one)
                if most != least or least > 8:
                    part = Part(None, part.head, part.tail, _known(part))
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            part = _EMPTY
        else:
            part = _ANY
        out = _join(out, part)
    return out


def trigram_query(pattern: str, flags: int = 0):
    """The trigram query of an expression, over A-Z lower-cased UTF-8; True if any text may match.

    Lower-casing only adds candidates, so it holds for expressions with and without regard
    to case.  One that disregards the case of letters beyond A-Z has no query: s then
    matches a letter of another script, and what stands for it is no trigram of s.
    """
    tree = _parser.parse(pattern, flags)
    if not tree.state.flags & re.ASCII and (tree.state.flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*i", pattern)):
        return True
    return _known(_walk(tree))


def grams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; group and least: the group that must have so many characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    flags: int = re.ASCII


#: The order of kinds among spans that start at the same place is the order here.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Spans that the index finds besides, for secrets with a mark of their own.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 20, 1),
)


class Scanner:
    """Rules with their queries, and the index of one segment at a time."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.grams = sorted(set().union(*map(grams_of, self.queries)))
        self.place = {g: i for i, g in enumerate(self.grams)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for g, i in self.place.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        # a run of hex digits is found faster by its least length
        self.match = [re.compile(f"[0-9a-f]{{{r.least},}}" if r.pattern == r"[0-9a-f]+" and not r.group else r.pattern, r.flags) for r in rules]

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each trigram of the queries, the sorted rows that hold it.  Trigrams that
        no query names are never looked up and get no postings."""
        base = int(offsets[0])
        text = tx._FOLD[data[base : int(offsets[-1])]]
        if len(text) < 3:
            return [np.zeros(0, np.int64) for _ in self.grams]
        wide = text.astype(np.uint32)
        found = self.slot[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(offsets - base, at, "right") - 1
        inside = at + 3 <= offsets[row + 1] - base
        key = np.unique(found[at[inside]].astype(np.int64) << 32 | row[inside])
        gram, row = key >> 32, key & 0xFFFFFFFF
        cuts = np.searchsorted(gram, np.arange(1, len(self.grams) + 2))
        return [row[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _rows(self, query, postings: list[np.ndarray]) -> np.ndarray:
        if query[0] == "gram":
            return postings[self.place[query[1]]]
        if query[0] == "or":
            return np.unique(np.concatenate([self._rows(q, postings) for q in query[1]]))
        found = sorted((self._rows(q, postings) for q in query[1]), key=len)
        out = found[0]
        for rows in found[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, rows, assume_unique=True)
        return out

    def verify(self, k: int, text: str) -> list[tuple[int, int]]:
        """Spans of rule k: leftmost, not overlapping; those too short are left out."""
        r = self.rules[k]
        return [m.span() for m in self.match[k].finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) of each row in order of start and rule."""
        data, offsets = tx.buffers(column)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for low, high in tx.slices(offsets):
            postings = self.postings(data, offsets[low : high + 1])
            rows = [np.arange(high - low) if q is True else self._rows(q, postings) for q in self.queries]
            texts: dict[int, str] = {}
            for k, found in enumerate(rows):
                for i in map(int, found):
                    if i not in texts:
                        texts[i] = data[offsets[low + i] : offsets[low + i + 1]].tobytes().decode("utf-8")
                    out[low + i] += [(a, b, k) for a, b in self.verify(k, texts[i])]
        for found in out:
            found.sort(key=lambda s: (s[0], s[2], s[1]))
        return out


_SPAN = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", to: str = "secrets") -> DataFrame:
    """`docs` with a column `to`: (kind, start, end) of every span, by start, then by
    the order of rules; code points, end exclusive.

    A null or empty text has no spans; rows with null or repeated ids stay as they are.
    A column of `docs` named `to` is replaced.  An empty table stays empty.
    """
    docs = docs.drop(to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T._parse_datatype_string(_SPAN))])
    at = docs.columns.index(text)
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in spans] for spans in scanner.spans(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(kind))], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_<kind> of the base rules, base_sha256, spans): counts and digests of the spans
    that `scan` found.  A null or empty text has counts of 0, no spans and the hash of
    nothing; rows with null or repeated keys are each digested."""
    base = [r.kind for r in BASE_RULES]
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scanned.select(
        key,
        *(of(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text") -> DataFrame:
    """`docs` with every secret in `text` replaced by "[kind]"; overlapping spans become
    one, named after the first.  A text without secrets, or null, stays as it is, and so
    do all other columns, whatever their names."""
    columns, spans = docs.columns, "spans"
    while spans in columns:
        spans += "_"
    found = scan(docs, rules, text, spans)
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.when(
            s["start"] >= acc["to"],
            F.struct(
                F.concat(acc["done"], F.substring(F.col(text), (acc["to"] + 1).cast("int"), (s["start"] - acc["to"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("done"),
                s["end"].alias("to"),
            ),
        ).otherwise(F.struct(acc["done"].alias("done"), F.greatest(acc["to"], s["end"]).alias("to"))),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), (acc["to"] + 1).cast("int"), F.length(text))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, step).otherwise(F.col(text))).select(*columns)


def _oracle() -> str:
    """`digest(scan(documents))` for DuckDB, for texts without the characters 1 and 2."""
    found = []
    for k, r in enumerate(BASE_RULES + MORE_RULES):
        pattern = (("(?i)" if r.flags & re.IGNORECASE else "") + r.pattern).replace("'", "''")
        found.append(
            f"""SELECT doc_id, row, {k} AS k, '{r.kind}' AS kind, start, start + length(found) AS stop FROM (
  SELECT doc_id, row, i, split_part(part, chr(2), 1) AS found, coalesce(sum(length(part)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - greatest(i - 2, 0) AS start
  FROM (SELECT doc_id, row, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, row, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM d)))
WHERE i > 1 AND length(regexp_extract(found, '{pattern}', {r.group})) >= {r.least}"""
        )
    base = len(BASE_RULES)
    shown = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, k)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
s AS ({' UNION ALL '.join(found)}), g AS (SELECT row, {counts}, {shown} FILTER (k < {base}) AS base, {shown} AS spans FROM s GROUP BY row)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""


ORACLE = _oracle()
