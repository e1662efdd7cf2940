"""Licence scan: ordered signature rules behind a keyword filter, with overlaps resolved by priority and containment.

A text becomes its words in lower case, one space between them. An automaton of all keywords runs over it once and says
which rules can match at all; most texts hold no keyword and are done. The rules that are left give detections, intervals
of words. A detection inside the interval of another is dropped if the other has a higher priority or, at the same
priority, is longer or written first; one that only overlaps another is dropped if the other's priority is higher.

The scan is one pass over the texts: no row meets another, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from vettra.llm.common import arrow_map, columns, texts
from vettra.llm.license_rules import KINDS, PHRASES, rules

# ASCII characters that are no letter or digit read as spaces; A-Z as a-z; all others stay.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_FOLD = bytes(ord(chr(c).lower()) if c < 128 else c for c in _PLAIN)


class Rule(NamedTuple):
    rank: int  # of its kind, 0 first
    order: int
    label: str
    sure: float
    pattern: re.Pattern


class Detection(NamedTuple):
    """A rule's match: words ``first`` to ``last``, last included."""

    first: int
    last: int
    rank: int
    order: int
    label: str
    sure: float


class Scanner:
    """Rules compiled once; ``words`` prepares a text, ``detections`` scans it."""

    def __init__(self, told: list[tuple[str, str, str, str]], phrases: dict[str, str]):
        import ahocorasick

        kinds = list(KINDS)
        by_keyword: dict[str, list[Rule]] = {}
        for order, (kind, label, keyword, pattern) in enumerate(told):
            rule = Rule(kinds.index(kind), order, label, KINDS[kind], re.compile(f"(?<= )(?:{pattern})(?= )"))
            by_keyword.setdefault(keyword, []).append(rule)
        self.phrases = {f" {phrase} ": label for phrase, label in phrases.items()}
        self.keywords = ahocorasick.Automaton()
        for keyword in {*by_keyword, *self.phrases}:
            self.keywords.add_word(keyword, (keyword, by_keyword.get(keyword, [])))
        self.keywords.make_automaton()

    def words(self, text: str | None) -> tuple[int, str]:
        """(number of words, the words with one space before and behind each)."""
        found = (text or "").encode().translate(_FOLD).split(b" ")
        found = [w for w in found if w]
        return len(found), f" {b' '.join(found).decode()} "

    def scan(self, line: str) -> tuple[list[tuple[int, str]], list[Detection]]:
        """(places of phrases, with labels; every detection of the rules) in prepared words."""
        gates = dict(found for _, found in self.keywords.iter(line))
        places = Places(line)
        base = sorted((places.word(at), label) for p, label in self.phrases.items() if p in gates for at in found_at(line, p))
        found = [
            Detection(places.word(m.start() - 1), places.word(m.end()) - 1, rule.rank, rule.order, rule.label, rule.sure)
            for open_rules in gates.values()
            for rule in open_rules
            for m in rule.pattern.finditer(line)
        ]
        return base, found


class Places:
    """Word numbers of the spaces in prepared words; spaces are listed once, when first asked for."""

    def __init__(self, line: str):
        self.line, self.spaces = line, None

    def word(self, space: int) -> int:
        """The number of the word behind the space at position ``space``."""
        if self.spaces is None:
            self.spaces = [m.start() for m in re.finditer(" ", self.line)]
        return bisect_left(self.spaces, space)


def found_at(line: str, piece: str) -> list[int]:
    """All positions of ``piece``, overlapping ones too."""
    out, at = [], line.find(piece)
    while at >= 0:
        out.append(at)
        at = line.find(piece, at + 1)
    return out


def resolved(found: list[Detection]) -> list[Detection]:
    """The detections that stay, in order of their first word. Sorting dominates: no pair is looked at twice."""
    kept: list[Detection] = []
    taken: list[tuple[int, int]] = []  # disjoint intervals of higher kinds, ascending
    for rank in sorted({d.rank for d in found}):
        mine = sorted((d for d in found if d.rank == rank), key=lambda d: (d.first, -d.last, d.order))
        starts, reach, stay = [a for a, _ in taken], -1, []
        for d in mine:
            if d.last <= reach:
                continue  # inside one of its own kind that is longer or written first
            k = bisect_left(starts, d.last + 1) - 1  # the last taken interval that begins within or before d
            if k >= 0 and taken[k][1] >= d.first:
                continue
            reach = d.last
            stay.append(d)
        kept += stay
        taken = merged(sorted(taken + [(d.first, d.last) for d in stay]))
    return sorted(kept, key=lambda d: (d.first, d.last, d.order))


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals, those that share words as one."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules(), PHRASES)


SCANNED = (
    "n_words bigint, base array<struct<word:bigint,label:string>>, "
    "detections array<struct<first:bigint,last:bigint,kind:string,label:string,sure:double>>"
)


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id bigint",)) -> DataFrame:
    """The columns in ``keep`` (name and type) and, of each whole text:

    ``n_words``     runs of characters other than ASCII ones that are no letter or digit
    ``base``        every place of a fixed phrase: the number of its first word, and its label; never suppressed
    ``detections``  what is left of the rules' matches: first and last word, kind, label and how sure it is

    Null, empty and wordless texts have no words and nothing is found. Repeated rows are scanned each for itself; other
    columns are not read. An empty table gives no rows.
    """
    names = dict(x.split(" ", 1) for x in keep)
    kinds = list(KINDS)

    def run(batch):
        tool = scanner()
        made: dict[str, list] = {"n_words": [], "base": [], "detections": []}
        for text in texts(batch):
            n, line = tool.words(text)
            base, found = tool.scan(line)
            made["n_words"].append(n)
            made["base"].append([{"word": at, "label": label} for at, label in base])
            left = resolved(found) if found else []
            made["detections"].append([
                {"first": d.first, "last": d.last, "kind": kinds[d.rank], "label": d.label, "sure": d.sure} for d in left
            ])
        return {name: batch.column(name) for name in names} | made

    return arrow_map(columns(docs, text="string", **names), ", ".join([*keep, SCANNED]), run)
