"""Byte-level BPE of whole texts by independent pieces, whatever encodes the single words.

A single space between two characters that are no white space always starts a new pre-split word, a single line end
there is a word of its own, and the word pattern never looks back. So the text may be cut there, each piece may be
encoded by itself, and results may be kept by piece.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import regex

from vettra.llm.common import Memo

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
LONG = 200  # characters; longer pieces are not worth keeping


_SHORT = [struct.Struct(f"<{n}I").pack for n in range(16)]


def packed(ids: list[int]) -> bytes:
    return _SHORT[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers.

    ``word`` gives the ids of one pre-split word; ``specials`` are the strings that stand for one id each. The ids of
    pieces are kept in a memo of bounded size.
    """

    def __init__(self, word: Callable[[str], list[int]], specials: dict[str, int], size: int = 350_000):
        self.word, self.specials = word, {text: packed([i]) for text, i in specials.items()}
        self.split = regex.compile(WORDS).findall
        marks = "|".join(map(re.escape, sorted(specials, key=len, reverse=True)))
        self.special = re.compile(f"({marks})") if specials else None
        short = lambda x: len(x) <= LONG
        self.known = Memo(self._piece, size, short)  # by piece, behind a space
        self.bare = Memo(lambda w: packed(self.word(w)), size // 4, short)  # by word, as it is
        self.starts = Memo(self._words, size // 4, short)  # by piece, at the beginning of a line
        self.ends = {x: self._words(x) for x in ",.;:!?"}
        self.line_end = self._words("\n")

    def _words(self, text: str) -> bytes:
        known, bare = self.known, self.bare
        return b"".join([known[w[1:]] if w[0] == " " and w[1:].isalpha() else bare[w] for w in self.split(text)])

    def _piece(self, piece: str) -> bytes:
        """A piece behind a space. Letters alone are one word, and a mark behind them is another."""
        if piece.isalpha():
            return packed(self.word(" " + piece))
        end = self.ends.get(piece[-1:])
        if end is not None and piece[:-1].isalpha():
            return self.known[piece[:-1]] + end
        return self._words(" " + piece)

    def _plain(self, text: str) -> bytes:
        known, starts = self.known.__getitem__, self.starts
        if _TWO_SPACES.search(text):
            first, *rest = _CUT.split(text)
            return starts[first] + b"".join(map(known, rest))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(starts[first] + b"".join(map(known, rest)))
        return self.line_end.join(lines)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = (self.specials[x] if x in self.specials else self._plain(x) for x in self.special.split(text) if x)
        return b"".join(parts)
