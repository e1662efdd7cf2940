"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts as one state with an arc per byte. Each merge ``(a, b) -> c``, in rank order, adds one gadget: a
copy of the state that arcs labelled ``a`` lead to, without its arc ``b``; arcs ``a`` now lead to the copy, and every
state with an arc ``a`` gets an arc ``c`` to where ``b`` led. All arcs of one label lead to one state throughout, so a
token names its target. A path spells a word's bytes by its labels in exactly one way: the word's encoding.

50,000 merges give 50,001 states with up to 50,256 arcs each. The arcs of a state follow from the gadgets that cut it
and are worked out on first use: an arc ``t`` is missing when a gadget removed ``t``, or removed a token on the left
edge of ``t`` before the next token of that edge was made. They are then kept in the transition table.

Words are encoded left to right by the longest arc that fits, going back to a shorter one from a dead end. A prefix of a
word has one path at most, so no position is left twice and the work stays within length times longest label. The start
state has an arc for every token, so a word that is itself a token is one transition; no word passes the automaton by.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from vettra.llm.common import Memo, arrow_map, columns, texts
from vettra.llm.pieces import PieceEncoder

# Fixed value: the printable ranges of the byte alphabet.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next after 0xFF."""
    plain = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Compiled from the merges; ``encode_word`` walks it, ``labels`` are the bytes of its arcs."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        top = max([*vocab.values(), *specials.values()], default=-1) + 1
        self.specials = specials
        self.labels: list[bytes] = [b""] * top
        for label, i in vocab.items():
            self.labels[i] = label
        for text, i in specials.items():
            self.labels[i] = text.encode()
        self.left, self.right = [-1] * top, [-1] * top
        self.made = [-1] * top  # the merge that made the token; bytes were there before
        self.cut: dict[int, int] = {}  # (a, b) -> the merge whose gadget removed arc b behind a
        self.target = [0] * top  # the state that arcs of the label lead to
        states = 1
        for rank, (first, second) in enumerate(merges):
            a, b, c = vocab[first], vocab[second], vocab[first + second]
            self.left[c], self.right[c], self.made[c] = a, b, rank
            self.cut[a << 32 | b] = rank
            self.target[c] = self.target[b]
            self.target[a] = states
            states += 1
        self.states = states
        # what the automaton has arcs for: bytes, and tokens that some merge makes
        self.ids = {label: i for label, i in vocab.items() if len(label) == 1 or self.made[i] >= 0}
        self.reach: dict[bytes, int] = {}  # three bytes -> length of the longest label that begins so
        for label in self.ids:
            self.reach[label[:3]] = max(len(label), self.reach.get(label[:3], 2))
        self.owner = {state: token for token, state in enumerate(self.target)}
        self.arcs = Memo(self._arc, 100_000)

    def _arc(self, key: int) -> bool:
        """Whether the state ``key >> 32`` has the arc ``key & 0xFFFFFFFF``."""
        state, token = key >> 32, key & 0xFFFFFFFF
        if state == 0:
            return True
        behind, until = self.owner[state], NEVER
        while behind >= 0:
            edge, before = token, NEVER
            while edge >= 0:
                gadget = self.cut.get(behind << 32 | edge, NEVER)
                if gadget < until and gadget <= before:  # equal: a gadget (a, a) -> c gives its copy no arc c
                    return False
                edge, before = self.left[edge], self.made[edge]
            behind, until = self.right[behind], self.made[behind]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        ids, arcs, target, reach, n = self.ids, self.arcs, self.target, self.reach, len(word)
        path, state, begin, end = [], 0, 0, reach.get(word[:3], 2)
        while begin < n:
            end = min(end, n)
            while end > begin:  # the longest label first; a position left again is never met by another path
                token = ids.get(word[begin:end])
                if token is not None and (state == 0 or arcs[state << 32 | token]):
                    break
                end -= 1
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                end, begin = begin - 1, begin - len(self.labels[path.pop()])
                state = target[path[-1]] if path else 0
                continue
            path.append(token)
            state, begin = target[token], end
            end += reach.get(word[end : end + 3], 2)
        return path

    def decode(self, ids: list[int]) -> str:
        """The text that the arcs' labels spell."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """The automaton of a vocabulary file in the JSON form of the tokenizers library (byte-level BPE)."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    letters = byte_letters()
    raw = {token: bytes(letters[x] for x in token) for token in told["model"]["vocab"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    specials = {x["content"]: x["id"] for x in told.get("added_tokens", []) if x["special"]}
    vocab = {raw[token]: i for token, i in told["model"]["vocab"].items()}
    return Automaton(vocab, [(raw[a], raw[b]) for a, b in merges], specials)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    automaton = load(path)
    return PieceEncoder(lambda word: automaton.encode_word(word.encode()), automaton.specials, 150_000)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id bigint",)) -> DataFrame:
    """``text`` of every row as ``ids array<int>``; columns in ``keep`` (name and type) are carried along.

    Null and empty texts give an empty array. Repeated rows give repeated rows. Texts of any length are encoded whole.
    """
    return _mapped(docs, path, keep, "ids array<int>", lambda a, buffer: {"ids": np.frombuffer(buffer, "<i4")})


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id bigint",)) -> DataFrame:
    """``ids`` of every row as ``text``: null for null ids, empty for none."""
    names = dict(x.split(" ", 1) for x in keep)

    def run(batch):
        automaton = load(path)
        made = {name: batch.column(name) for name in names}
        return made | {"text": [None if x is None else automaton.decode(x) for x in texts(batch, "ids")]}

    return arrow_map(columns(rows, ids="array<int>", **names), ", ".join([*keep, "text string"]), run)


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id bigint",)) -> DataFrame:
    """Encode every text, decode the ids again, and return the count of ids and the digests of ids and decoded text."""

    def told(automaton: Automaton, buffer: bytes) -> dict:
        text = automaton.decode(np.frombuffer(buffer, "<u4").tolist())
        return {
            "n_tokens": len(buffer) // 4,
            "ids_sha256": hashlib.sha256(buffer).hexdigest(),
            "decoded_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }

    return _mapped(docs, path, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", told)


def _mapped(docs: DataFrame, path: str, keep: tuple[str, ...], added: str, told) -> DataFrame:
    names = dict(x.split(" ", 1) for x in keep)

    def run(batch):
        tool, automaton = encoder(path), load(path)
        rows = [told(automaton, tool.encode(t)) for t in texts(batch)]
        made = {name: batch.column(name) for name in names}
        return made | {x.split()[0]: [r[x.split()[0]] for r in rows] for x in added.split(", ")}

    return arrow_map(columns(docs, text="string", **names), ", ".join([*keep, added]), run)
