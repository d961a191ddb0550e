"""Cues of short texts: which families of words occur, which stand near each other, and what follows from that.

A Lexicon is data: families of words, chains of families with the characters that may lie
between them, links (a name, what may join it to a noun, the noun) and shapes.  All words
are in one automaton that reads a text once, without its white space, and gives the places
of every family; chains and links are range tests on places.  Rules over the cues are an
ordered list, of which the first that holds decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, product

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Places = list[tuple[int, int]]
_BREAK = re.compile("[\n\r\u2028\u2029]")


def words(text: str) -> tuple[str, ...]:
    """The words of a list that commas separate."""
    return tuple(w.strip() for w in text.split(",") if w.strip())


def each(*parts: tuple[str, ...] | str) -> tuple[str, ...]:
    """Every way to put one of each part together."""
    return tuple("".join(x) for x in product(*((p,) if isinstance(p, str) else p for p in parts)))


def _spaces(word: str) -> frozenset[int]:
    """Before which of a word's characters that aren't white space it may stand."""
    out, n = set(), 0
    for c in word.strip("<>"):
        if c in " ␣":
            out.add(n)
        else:
            n += 1
    return frozenset(out)


def _gaps(word: str) -> list[tuple[int, str]]:
    """White space inside a word: before which of the other characters, and its last character."""
    out, n = [], 0
    for c in word:
        if c.isspace() or c == "␣":
            if out and out[-1][0] == n:
                out.pop()
            out.append((n, c))
        else:
            n += 1
    return out


#: Spellings of a word that are remembered, at most.
_SPELLINGS = 200


class Text:
    """A text in lower case without its white space, and the places of its characters."""

    __slots__ = ("text", "tight", "low", "_black", "_at")

    def __init__(self, text: str):
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        self.text, self.low, self._black = text, low, low.split()
        self.tight = "".join(self._black)
        self._at: list[int] | range | None = None

    @property
    def at(self) -> list[int] | range:
        """The places in the text of the characters of `tight`."""
        if self._at is None:
            low, black, size = self.low, self._black, len(self.tight)
            if len(low) == size:
                self._at = range(size)
            elif len(low) - size == len(black) - 1:  # one between any two words, and none around them
                if len(black) < 30:
                    at: list[int] = []
                    begin = 0
                    for w in black:
                        end = begin + len(w)
                        at.extend(range(begin, end))
                        begin = end + 1
                    self._at = at
                else:
                    before = np.repeat(np.arange(len(black)), np.fromiter(map(len, black), np.int64, len(black)))
                    self._at = (before + np.arange(size)).tolist()
            else:
                self._at = [i for i, c in enumerate(low) if not c.isspace()]
        return self._at


@dataclass(frozen=True)
class Link:
    """A name that none of the characters `not_after` precede, joined by `gap` to a noun."""

    names: str
    gap: str
    nouns: str
    not_after: str


@dataclass(frozen=True)
class Lexicon:
    """`families` of words: a space in a word is white space or nothing, ␣ is white space, <word>
    has no letter, digit or _ of ASCII beside it.  `unless` are beginnings that must not follow a word of
    a family.  `chains` are alternatives of (family, most characters between, family, ...), and those of
    `either` of (family, most, family) in any order.  Words of `literal` families stand as they are but for
    case, those of `exact` ones just as they are.
    `derived` cues follow from others in their order; for some, `because` has those of which each needs one,
    as `letters` has characters of which a shape needs one."""

    families: dict[str, tuple[str, ...]]
    chains: dict[str, tuple[tuple, ...]] = field(default_factory=dict)
    either: dict[str, tuple[tuple, ...]] = field(default_factory=dict)
    links: dict[str, tuple[Link, ...]] = field(default_factory=dict)
    shapes: dict[str, str] = field(default_factory=dict)
    unless: dict[str, tuple[str, ...]] = field(default_factory=dict)
    literal: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    derived: dict[str, Callable[[set[str]], bool]] = field(default_factory=dict)
    because: dict[str, tuple[str, ...]] = field(default_factory=dict)
    letters: dict[str, str] = field(default_factory=dict)


class Reader:
    """A lexicon made ready to read texts; its size is that of the words in it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._machines: dict[frozenset[str], ahocorasick.Automaton] = {}
        self.machine = self.of(frozenset(lexicon.families))
        self.empty = not len(self.machine)
        #: Families that were needed to find a cue in the texts so far.
        self.needs: dict[str, set[str]] = {}
        self.shapes = {k: re.compile(p) for k, p in lexicon.shapes.items()}
        #: Chains by their first family: (cue, parts, families, whether any order will do), and by cue.
        self.chains: dict[str, list[tuple[str, tuple, frozenset[str], bool]]] = {}
        self.options: dict[str, list[tuple[tuple, frozenset[str], bool]]] = {}
        for free, kinds in ((False, lexicon.chains), (True, lexicon.either)):
            for k, options in kinds.items():
                for x in options:
                    self.chains.setdefault(x[0], []).append((k, x, frozenset(x[::2]), free))
                    self.options.setdefault(k, []).append((x, frozenset(x[::2]), free))
        #: Places of the derived cues in their order, families to read for the others, and derived ones whose names others have, too.
        self.order = {k: i for i, k in enumerate(lexicon.derived)}
        self.read_for = {k: frozenset([k]) for k in lexicon.families}
        for k, options in self.options.items():
            self.read_for[k] = self.read_for.get(k, frozenset()).union(*(need for _, need, _ in options))
        for k, links in lexicon.links.items():
            self.read_for[k] = self.read_for.get(k, frozenset()).union(*((x.names, x.nouns) for x in links))
        self.own = self.order.keys() & {*lexicon.families, *self.options, *lexicon.links, *lexicon.shapes}
        self.gaps = {k: [(x, re.compile(x.gap), re.compile(x.not_after) if x.not_after else None) for x in v] for k, v in lexicon.links.items()}

    def of(self, families: frozenset[str]) -> ahocorasick.Automaton:
        """The automaton of some families' words: a word's size, the words with their families, and, by how
        it is spelt in a text, which of them that may be."""
        machine = self._machines.get(families)
        if machine is None:
            found: dict[str, list[tuple[str, str]]] = {}
            for name in self.lexicon.families:
                for w in dict.fromkeys(self.lexicon.families[name]) if name in families else ():
                    found.setdefault(re.sub(r"[ ␣<>]", "", w).lower(), []).append((name, w))
            machine = ahocorasick.Automaton()
            for key, uses in found.items():
                machine.add_word(key, (len(key), uses, {}))
            if found:
                machine.make_automaton()
            self._machines[families] = machine
        return machine

    def _spelt(self, uses: list[tuple[str, str]], spelling: str) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
        """Families of those words that are spelt so, white space included, and the words that what is around them decides on."""
        x, names, more = self.lexicon, [], []
        white = {n for n, _ in _gaps(spelling)}
        for name, word in uses:
            strict = "␣" in word or name in x.exact or name in x.literal
            if not white <= _spaces(word) or (strict and not self._stands(name, word, spelling, white)):
                continue
            if word[0] == "<" or word[-1] == ">" or name in x.unless:
                more.append((name, word))
            else:
                names.append(name)
        return tuple(names), tuple(more)

    def _stands(self, name: str, word: str, spelling: str, white: set[int]) -> bool:
        """Whether a word is spelt so, with white space before those of the other characters."""
        inner, x = word.strip("<>"), self.lexicon
        if not {n for n, c in _gaps(inner) if c == "␣"} <= white or (name in x.exact and spelling != inner):
            return False
        return name not in x.literal or spelling.lower() == inner.lower()

    def found(self, text: Text, families: frozenset[str] | None = None) -> tuple[dict[tuple[str, ...], Places], dict[str, Places]]:
        """Where words of some families or all occur: by the families that all words of a spelling are of, and by
        family for those words of which more had to be tested.  Not in order."""
        plainly: dict[tuple[str, ...], Places] = {}
        out: dict[str, Places] = {}
        machine = self.machine if families is None else self.of(families)
        if not len(machine) or not text.tight:
            return plainly, out
        raw, tight, at = text.text, text.tight, None
        for last, (size, uses, spellings) in machine.iter(tight):
            if at is None:
                at = text.at
            first = last - size + 1
            start, end = at[first], at[last] + 1
            spelling = raw[start:end]
            known = spellings.get(spelling)
            if known is None:
                known = self._spelt(uses, spelling)
                if len(spellings) < _SPELLINGS:
                    spellings[spelling] = known
            names, more = known
            if names:
                if names in plainly:
                    plainly[names].append((start, end))
                else:
                    plainly[names] = [(start, end)]
            for name, word in more:
                if self._alone(name, word, raw, tight, last, start, end):
                    out.setdefault(name, []).append((start, end))
        return plainly, out

    def places(self, text: str) -> dict[str, Places]:
        """Where each family occurs, in order of start."""
        plainly, out = self.found(Text(text))
        for names, group in plainly.items():
            for name in names:
                out.setdefault(name, []).extend(group)
        for group in out.values():
            group.sort()
        return out

    def _alone(self, name: str, word: str, text: str, tight: str, last: int, start: int, end: int) -> bool:
        """Whether what is around a word lets it be one."""
        if word[0] == "<" and start and re.match(r"[A-Za-z0-9_]", text[start - 1]):
            return False
        if word[-1] == ">" and end < len(text) and re.match(r"[A-Za-z0-9_]", text[end]):
            return False
        return not any(tight.startswith(x, last + 1) for x in self.lexicon.unless.get(name, ()))

    @staticmethod
    def _follows(ends: list[int], within: int, group: Places, breaks: list[int]) -> list[int]:
        """Ends of the places of `group` that begin at most `within` characters after one of `ends`."""
        starts, out = [s for s, _ in group], set()
        for e in ends:
            k = bisect_left(breaks, e)
            most = min(e + within, breaks[k] if k < len(breaks) else e + within)
            i = bisect_left(starts, e)
            while i < len(starts) and starts[i] <= most:
                out.add(group[i][1])
                i += 1
        return sorted(out)

    def _chained(self, parts: tuple, places: dict[str, Places], breaks: list[int]) -> bool:
        ends = sorted({e for _, e in places[parts[0]]})
        for within, name in zip(parts[1::2], parts[2::2], strict=True):
            ends = self._follows(ends, within, places[name], breaks)
            if not ends:
                return False
        return True

    def _linked(self, link: Link, gap: re.Pattern, not_after: re.Pattern | None, text: str, places: dict[str, Places]) -> bool:
        nouns = places.get(link.nouns, [])
        for start, end in places.get(link.names, []) if nouns else []:
            if not_after is not None and start and not_after.match(text[start - 1]):
                continue
            for k in range(bisect_left(nouns, (end, 0)), len(nouns)):
                s = nouns[k][0]
                if gap.fullmatch(text, end, s):
                    return True
                if s - end > 80:
                    break
        return False

    def cues(self, text: str) -> set[str]:
        """Names of the families, chains, links, shapes and derived cues of a text."""
        lexicon, places = self.lexicon, self.places(text)
        out = set(places)
        if places:
            here = places.keys()
            breaks = [m.start() for m in _BREAK.finditer(text)]
            for name in here:
                for k, x, need, free in self.chains.get(name, ()):
                    if need <= here and k not in out and (self._chained(x, places, breaks) or (free and self._chained(x[::-1], places, breaks))):
                        out.add(k)
            out |= {k for k, options in self.gaps.items() if any(self._linked(*x, text, places) for x in options)}
        out |= {k for k, p in self.shapes.items() if p.search(text)}
        for k, holds in lexicon.derived.items():
            if holds(out):
                out.add(k)
        return out


class Cues:
    """The cues of a text as a set of which each is looked for when it is first asked for.  A short text is read
    once for all families, a long one for those that a cue needs."""

    __slots__ = ("reader", "text", "names", "_known", "_upto", "_asked", "_form", "_loaded", "_times", "_found", "_sorted", "_breaks")

    def __init__(self, reader: Reader, text: str):
        self.reader, self.text = reader, text
        #: Names of the families read so far that the text holds.
        self.names: set[str] = set()
        self._known: dict[str, bool] = {}
        self._upto, self._asked, self._times = len(reader.order), None, 0
        self._form: Text | None = None
        self._loaded: set[str] | None = set()
        self._found: list[tuple[dict[tuple[str, ...], Places], dict[str, Places]]] = []
        self._sorted: dict[str, Places] = {}
        self._breaks: list[int] | None = None

    def _load(self, families: Iterable[str] | None) -> None:
        """Read the text for families, or all, that it wasn't read for."""
        if self._loaded is None:
            return
        more = None
        if families is not None and len(self.text) > _LONG and self._times < _TIMES:
            more = frozenset(families) - self._loaded
            if not more:
                return
            if self._asked is not None:
                self.reader.needs.setdefault(self._asked, set()).update(more)
        if self._form is None:
            self._form = Text(self.text)
        self._times += 1
        if more is None:
            self._found, self._loaded = [self.reader.found(self._form)], None
            self._form = None
        else:
            self._found.append(self.reader.found(self._form, more))
            self._loaded |= more
        plainly, out = self._found[-1]
        self.names.update(out, *plainly)

    def __getitem__(self, family: str) -> Places:
        """Where a family occurs that was read."""
        got = self._sorted.get(family)
        if got is None:
            got = self._sorted[family] = sorted(x for plainly, out in self._found for x in (*out.get(family, ()), *(y for names, group in plainly.items() if family in names for y in group)))
        return got

    def get(self, family: str, otherwise: Places) -> Places:
        return self[family] if family in self.names else otherwise

    def _stands(self, name: str) -> bool:
        """Whether the text has a cue by itself, and not because it has others."""
        r = self.reader
        shape = r.shapes.get(name)
        if shape is not None and (name not in r.lexicon.letters or any(c in self.text for c in r.lexicon.letters[name])) and shape.search(self.text):
            return True
        families = r.read_for.get(name)
        if families is None:
            return False
        if self._loaded is not None:
            self._load(families)
        if name in self.names:
            return True
        for x, need, free in r.options.get(name, ()):
            if need <= self.names:
                if self._breaks is None:
                    self._breaks = [m.start() for m in _BREAK.finditer(self.text)]
                if r._chained(x, self, self._breaks) or (free and r._chained(x[::-1], self, self._breaks)):
                    return True
        return any(r._linked(*x, self.text, self) for x in r.gaps.get(name, ()))

    def __contains__(self, name: str) -> bool:
        known = self._known.get(name)
        if known is None:
            r, first = self.reader, self._asked is None
            place = r.order.get(name)
            if place is not None and place >= self._upto:  # a cue can follow only from those before it
                return name in r.own and self._stands(name)
            if first:
                self._asked = name
                if self._loaded is not None and name in r.needs and len(self.text) > _LONG:
                    self._load(r.needs[name])
            known = (place is None or name in r.own) and self._stands(name)
            if not known and place is not None:
                before, self._upto = self._upto, place
                known = bool(r.lexicon.derived[name](self))
                self._upto = before
            self._known[name] = known
            if first:
                self._asked = None
        return known

    def isdisjoint(self, names: Iterable[str]) -> bool:
        for n in names:
            if n in self:
                return False
        return True

    def issuperset(self, names: Iterable[str]) -> bool:
        for n in names:
            if n not in self:
                return False
        return True

    __ge__ = issuperset

    def __rand__(self, names: set[str]) -> set[str]:
        return {n for n in names if n in self}

    def __bool__(self) -> bool:
        if not self.names:
            self._load(None)
        return bool(self.names) or any(k in self for k in (*self.reader.shapes, *self.reader.order))


class Parts(list):
    """Segments of a text, with those of them in which a cue can be."""

    def __init__(self, reader: Reader, segments: Iterable[str]):
        super().__init__(segments)
        self.reader = reader
        self._where: dict[str | tuple[str], frozenset[int]] = {}

    @cached_property
    def _tight(self) -> tuple[str, list[int]]:
        """All segments in lower case without white space, and where each ends."""
        low = Text("\n".join(self)).low.split("\n")
        if len(low) != len(self):
            low = [Text(s).low for s in self]
        tight = ["".join(s.split()) for s in low]
        return "".join(tight), list(accumulate(map(len, tight)))

    def _holding(self, family: str) -> frozenset[int]:
        """Segments that hold a word of a family, whatever is around it or of white space in it."""
        known = self._where.get((family,))
        if known is None:
            machine, (tight, ends), out = self.reader.of(frozenset([family])), self._tight, set()
            for last, (size, _, _) in machine.iter(tight) if len(machine) else ():
                i = bisect_right(ends, last)
                if last - size + 1 >= (ends[i - 1] if i else 0):
                    out.add(i)
            known = self._where[(family,)] = frozenset(out)
        return known

    def where(self, name: str) -> frozenset[int]:
        """Places of the segments that can have a cue; all others don't have it."""
        known = self._where.get(name)
        if known is None:
            r = self.reader
            if name in r.shapes or name in r.own or (name in r.order and name not in r.lexicon.because):
                known = frozenset(range(len(self)))
            elif name in r.order:
                known = frozenset().union(*map(self.where, r.lexicon.because[name]))
            else:
                sets = [self._holding(name)] if name in r.lexicon.families else []
                for need in (*(need for _, need, _ in r.options.get(name, ())), *((x.names, x.nouns) for x, _, _ in r.gaps.get(name, ()))):
                    both = None
                    for family in need:
                        both = self._holding(family) if both is None else both & self._holding(family)
                        if not both:
                            break
                    sets.append(both)
                known = frozenset().union(*sets)
            self._where[name] = known
        return known


#: Characters from which a text is long, and how often one is read for some families before it is for all.
_LONG, _TIMES = 200, 6


def clauses(segment: str, begins: Callable[[str, str], bool]) -> list[str]:
    """A segment cut at those of its commas behind which, as `begins` says of a clause and of what
    stands before it, something else is spoken of."""
    out: list[str] = []
    for part in re.split(r",\s*", segment):
        part = part.strip()
        if not out or begins(part, out[-1]):
            out.append(part)
        else:
            out[-1] = f"{out[-1]}, {part}"
    return out


SCOPE = "struct<cues: array<string>, segments: array<struct<text: string, cues: array<string>>>>"


@dataclass(frozen=True)
class Reading:
    """What a worker reads texts with: the reader, the function that cuts a text into segments, and the
    one that makes the scopes, texts by name, of an item's columns."""

    reader: Reader
    cut: Callable[[str], list[str]]
    scopes: Callable[..., dict[str, str]]

    def read(self, text: str) -> dict:
        whole = self.reader.cues(text) if text else set()
        parts = [(s, self.reader.cues(s)) for s in self.cut(text)] if whole else []
        return {"cues": sorted(whole), "segments": [{"text": s, "cues": sorted(c)} for s, c in parts if c]}


#: Characters of a slice of a batch, about, and rows at most; what is found in a slice is handed on before the next is read.
_SLICE_CHARS, _SLICE_ROWS = 1 << 20, 500


def slices(*texts: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """The rows of some columns of text in slices of some _SLICE_CHARS characters, so that what is made of a
    slice is small however long the texts of a batch are."""
    begin = held = 0
    sizes = sum(t.str.len().fillna(0) for t in texts)
    for i, n in enumerate(sizes):
        if i > begin and (held + n > _SLICE_CHARS or i - begin >= _SLICE_ROWS):
            yield tuple(t.iloc[begin:i] for t in texts)
            begin, held = i, 0
        held += n
    if len(sizes) > begin:
        yield tuple(t.iloc[begin:] for t in texts)


def spread(items: DataFrame, alike: Column | None = None) -> DataFrame:
    """`items` dealt over all cores, for narrow rows on which much work is done: a file of them may be one task.
    Rows of equal `alike` come one after another, so that what was found for one is at hand for the next."""
    n = 4 * items.sparkSession.sparkContext.defaultParallelism
    if alike is None:
        return items.repartition(n)
    return items.withColumn("_alike", F.xxhash64(alike)).repartition(n, "_alike").sortWithinPartitions("_alike").drop("_alike")


def with_cues(items: DataFrame, columns: list[Column], names: tuple[str, ...], make: Callable[[], Reading], name: str = "evidence") -> DataFrame:
    """`items` with a struct of the scopes `names` of the text columns: the cues of each whole text, and its
    segments that hold cues.  `make` is called once in each worker; a null text is empty."""
    kind = "struct<" + ", ".join(f"{k}: {SCOPE}" for k in names) + ">"

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        reading = make()
        for batch in batches:
            for texts in slices(*(batch if isinstance(batch, tuple) else (batch,))):  # one column comes alone
                rows = [reading.scopes(*(t or "" for t in row)) for row in zip(*texts, strict=True)]
                yield pd.DataFrame({k: [reading.read(r[k]) for r in rows] for k in names})

    found = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)
    return items.withColumn(name, found(*columns))


class View:
    """The cues of a text, and its segments with theirs."""

    def __init__(self, cues: Callable[[str], Cues | set[str]], cut: Callable[[str], Sequence[str]], text: str):
        self.cues, self._read, self._cut, self.text = cues(text) if text else frozenset(), cues, cut, text

    @cached_property
    def segments(self) -> Sequence[str]:
        return self._cut(self.text) if self.cues else ()

    @cached_property
    def parts(self) -> list[tuple[str, Cues | set[str]]]:
        return [(s, self._read(s)) for s in self.segments]

    def has(self, *cues: str) -> bool:
        """Whether the text holds one of the cues."""
        return not self.cues.isdisjoint(cues)

    def some(self, *cues: str) -> bool:
        """Whether one segment holds one of the cues."""
        if isinstance(self.segments, Parts):
            return any(cue in self._read(self.segments[i]) for cue in cues for i in self.segments.where(cue))
        return any(not c.isdisjoint(cues) for _, c in self.parts)

    def both(self, *cues: str) -> bool:
        """Whether one segment holds them all."""
        if isinstance(self.segments, Parts):
            return any(self._read(self.segments[i]).issuperset(cues) for i in frozenset.intersection(*map(self.segments.where, cues)))
        return any(c.issuperset(cues) for _, c in self.parts)

    def any(self, holds: Callable[[str, Cues | set[str]], bool]) -> bool:
        return any(holds(s, c) for s, c in self.parts)


#: Rules (name, outcome, condition) in the order in which they decide.
RuleList = list[tuple[str, str, Callable[..., bool]]]


def decide(rules: RuleList, otherwise: tuple[str, str], *seen) -> tuple[str, str]:
    """Name and outcome of the first rule whose condition holds of what was seen."""
    return next(((name, outcome) for name, outcome, holds in rules if holds(*seen)), otherwise)


def ruled(items: DataFrame, column: Column, make: Callable[[], tuple[Reading, RuleList, tuple[str, str]]], name: str = "gate") -> DataFrame:
    """`items` with a struct of the rule that decides on a text, and its outcome; a null text is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reading, rules, otherwise = make()
        for texts in (part for batch in batches for (part,) in slices(batch)):
            views = (View(reading.reader.cues, reading.cut, t or "") for t in texts)
            yield pd.DataFrame([decide(rules, otherwise, v) for v in views], columns=["rule", "outcome"])

    return items.withColumn(name, F.pandas_udf(run, "struct<rule: string, outcome: string>", F.PandasUDFType.SCALAR_ITER)(column))
