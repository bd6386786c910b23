"""Fill-in-middle: a text is cut in three at places drawn from its id, and its middle moves to the end behind sentinels.

Places are counted in units. A kind of unit gives each ASCII character a class, and a class is either `single`, where every
character is a unit, or joined, where a run of its characters is one; all other characters have the class of
ordinary ones. One Aho-Corasick automaton, made of the ASCII characters that change the class and of the sentinels, scans a text. Its events are
few: between two of them lie ordinary characters only, so the units of a gap are a matter of arithmetic (its length, or one), and running sums over
the events give the number of units before each. The place of the r-th unit is then a binary search among the events
and a subtraction within a gap. For code points, the kind of the query, nothing changes the class, and the sentinels are the only events.

Forms: plain, where the text is empty, holds a sentinel or is drawn to stay; psm, prefix suffix middle; spm, suffix prefix
middle. Draws are the first four 8-digit groups of the SHA-256 of "seed:id", so reruns agree. No sentinel may lie within another or
overlap one; then what was put in is found again, whatever the parts hold, and the exact text comes back.

Defined cases: null and empty texts are plain; a null id draws as an empty one would; repeated rows are repeated, rows of one id draw alike
and are cut by their own lengths; empty tables give empty results; columns but id and text are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 1, 90, 20
_WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Units:
    """classes: the ASCII characters that aren't ordinary, by class; single: the classes, `None` for ordinary characters, of which each character is a unit."""

    classes: tuple[str, ...] = ()
    single: frozenset[int | None] = frozenset({None})


#: Every code point; every word and every run of white space; every line with its end.
CODE_POINTS = Units()
WORDS = Units((_WHITE,), frozenset())
WORDS_AND_MARKS = Units((_WHITE, "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())), frozenset({1}))


class Scanner:
    def __init__(self, units: Units, sentinels: tuple[str, ...]):
        import ahocorasick

        clash = any(a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) for a, b in permutations(sentinels, 2)) or any(s.endswith(s[:k]) for s in sentinels for k in range(1, len(s)))
        if clash or not all(sentinels):
            raise ValueError("sentinels must not be empty, contain or overlap one another")
        self.sentinels = {s: k for k, s in enumerate(sentinels)}
        self.single = units.single
        self.automaton = ahocorasick.Automaton()
        for kind, chars in enumerate(units.classes):
            for c in chars:
                self.automaton.add_word(c, (True, kind, 1))
        for s, k in self.sentinels.items():
            if s in self.automaton:
                raise ValueError("a sentinel is a class-changing character")
            self.automaton.add_word(s, (False, k, len(s)))
        self.automaton.make_automaton()

    def events(self, text: str) -> tuple[list[tuple[int, int | None]], list[tuple[int, int]]]:
        """(place, class) of the class-changing characters; (place, number) of the sentinels."""
        changes, found = [], []
        for end, (is_change, kind, length) in self.automaton.iter(text):
            (changes if is_change else found).append((end + 1 - length, kind))
        return changes, found

    def ranks(self, text: str, changes: list[tuple[int, int | None]]) -> Ranks:
        return Ranks(len(text), changes, self.single)


class Ranks:
    """Which place each unit ends at, from the events alone.

    Spans of one class follow one another: (start, units before, single?). A run of equal class-changing characters is one span.
    """

    def __init__(self, length: int, changes: list[tuple[int, int | None]], single: frozenset[int | None]):
        self.starts, self.before, self.each = [], [], []
        self.length, self.n, at, last = length, 0, 0, object()

        def span(start: int, end: int, kind) -> None:
            nonlocal last
            if end == start:
                return
            if kind != last:
                self.starts.append(start)
                self.before.append(self.n)
                self.each.append(kind in single)
            if kind != last or kind in single:
                self.n += end - start if kind in single else 1
            last = kind

        for place, kind in changes:
            span(at, place, None)
            span(place, place + 1, kind)
            at = place + 1
        span(at, length, None)

    def end_of(self, rank: int) -> int:
        """The place after the first `rank` units."""
        if rank <= 0:
            return 0
        k = bisect_left(self.before, rank) - 1
        if self.each[k]:
            return self.starts[k] + rank - self.before[k]
        return self.starts[k + 1] if k + 1 < len(self.starts) else self.length


def arrange(form: str, prefix: str, middle: str, suffix: str, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    p, s, m = sentinels
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restore(scanner: Scanner, output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    order = (0, 1, 2) if form == "psm" else (1, 0, 2)
    found = scanner.events(output)[1]
    if tuple(k for _, k in found) != order or found[0][0]:
        raise ValueError("the sentinels of an output aren't those of its form")
    lengths = {k: len(s) for s, k in scanner.sentinels.items()}
    ends = [*(place for place, _ in found[1:]), len(output)]
    part = {k: output[place + lengths[k] : end] for (place, k), end in zip(found, ends, strict=True)}
    return part[0] + part[2] + part[1]


def transformed(
    docs: DataFrame, units: Units = CODE_POINTS, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of each document. Without a shuffle."""
    Scanner(units, sentinels)
    i = F.col(id_col).cast("long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(i.cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(i.alias("i"), *draws, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(units, sentinels)
        for part in shared.slices(batches, "t"):
            out = []
            for text, h1, h2, h3, h4 in zip(*(part.column(c).to_pylist() for c in ("t", "h1", "h2", "h3", "h4")), strict=True):
                changes, found = scanner.events(text)
                ranks = scanner.ranks(text, changes)
                if not text or found or h3 % 100 >= percent:
                    out.append((ranks.n, "plain", None, None, text))
                    continue
                a, b = sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1)))
                a, b, form = ranks.end_of(a), ranks.end_of(b), "spm" if h4 % 100 < spm_percent else "psm"
                out.append((ranks.n, form, a, b - a, arrange(form, text[:a], text[a:b], text[b:], sentinels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("i"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """What `transformed` made, with the text rebuilt from output and form. Without a shuffle."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(CODE_POINTS, sentinels)
        for part in shared.slices(batches, "output"):
            texts = [restore(scanner, x, form) for x, form in zip(part.column("output").to_pylist(), part.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return made.select(*names).mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
