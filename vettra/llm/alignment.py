"""Alignment of two tokenizers over the same texts: where both end a token, and which ids end there together.

A is a byte-level BPE vocabulary of the tokenizers library, B a sentencepiece model that puts a space before the text; A
encodes the text behind a space, so both spell the same bytes. Token ends of a text are two ascending lists, and the
alignment is their merge. All texts of a batch are merged in lockstep: one state vector holds a pair of pointers a lane,
every step compares the ends under all pointers and moves the lower one of each pair, or both where they agree, and then
emits a link. Lanes that are done are taken out of the vector. A long text takes several lanes, one for every ``LANE``
bytes: links are agreements of ends, so the merge of one range of offsets does not depend on another, and the number of
steps is bounded by the length of a lane.

A link is also a cut: the tokens of A and of B since the last cut are a group. Of two tokens that end together, the bytes
of the shorter are the end of the longer's. So the vocabularies alone say which pairs of ids can ever be linked: a few
hundred thousand. They are numbered, texts keep the numbers of their links, and the counts of all pairs over a whole
corpus are one vector of that length, however large the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettra.llm import bpe_automaton
from vettra.llm.common import arrow_map, columns, stored, texts
from vettra.llm.library_encoder import encoder

LANE = 512  # bytes
CHUNK = 500_000  # bytes of text that are merged at once
MOST_PAIRS = 20_000_000  # linkable pairs of two vocabularies; their counts travel with each task


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the numbered pairs of ids that can end together."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        automaton = bpe_automaton.load(path_a)
        self.a = encoder(path_a, specials=False, size=150_000).encode
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = automaton.labels
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a], "i8")
        self.size_b = np.array([len(x) for x in self.bytes_b], "i8")
        special = set(automaton.specials.values())
        ids_a = {i: x for i, x in enumerate(self.bytes_a) if x and i not in special}
        ids_b = {i: x for i, x in enumerate(self.bytes_b) if x}
        self.pairs = self._linkable(ids_a, ids_b)
        if len(self.pairs) > MOST_PAIRS:
            raise ValueError(f"{len(self.pairs)} pairs of ids can be linked, more than {MOST_PAIRS}")
        self.b_of_pair = (self.pairs & 0xFFFFFFFF).astype("i8")
        # every id of A behind each of its two separators, then every id of B behind its own
        self.spelled = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self.spelled += [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"]

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _linkable(ids_a: dict[int, bytes], ids_b: dict[int, bytes]) -> np.ndarray:
        """``a << 32 | b`` of all ids of which one's bytes end with the other's, ascending."""
        by_bytes_a: dict[bytes, list[int]] = {}
        by_bytes_b: dict[bytes, list[int]] = {}
        for i, x in ids_a.items():
            by_bytes_a.setdefault(x, []).append(i)
        for i, x in ids_b.items():
            by_bytes_b.setdefault(x, []).append(i)
        found = {a << 32 | b for a, x in ids_a.items() for k in range(len(x)) for b in by_bytes_b.get(x[k:], ())}
        found |= {a << 32 | b for b, x in ids_b.items() for k in range(len(x)) for a in by_bytes_a.get(x[k:], ())}
        return np.array(sorted(found), "i8")

    def encoded(self, told: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; none where the bytes of either are not those of the text behind a space."""
        out = []
        for text, ids_b in zip(told, self.b.encode([t or "" for t in told], num_threads=1), strict=True):
            raw = b" " + text.encode() if text else b""
            ids_a = np.frombuffer(self.a(f" {text}") if text else b"", "<u4").astype("i8")
            same = raw and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw
            if same and b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == raw:
                out.append((ids_a, np.array(ids_b, "i8")))
            else:
                out.append((np.empty(0, "i8"), np.empty(0, "i8")))
        return out

    def links(self, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        """The numbers of linked pairs of ids."""
        return np.searchsorted(self.pairs, ids_a << 32 | ids_b).astype("i4")


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def merge(ends_a: np.ndarray, ends_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two strictly ascending lists of equal values, by lockstep merging of lanes of ``lane`` offsets.

    The lists may be those of many texts, each shifted by the bytes of those before it.
    """
    last = max(ends_a[-1] if len(ends_a) else 0, ends_b[-1] if len(ends_b) else 0)
    bounds = np.arange(0, last + lane, lane)
    at_a, at_b = np.searchsorted(ends_a, bounds, "right"), np.searchsorted(ends_b, bounds, "right")
    state = np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]])  # next and end in A, next and end in B
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        state = state[:, (state[0] < state[1]) & (state[2] < state[3])]
        if not state.shape[1]:
            break
        i, j = state[0], state[2]
        x, y = ends_a[i], ends_b[j]
        same = x == y
        found.append((i[same], j[same]))
        state[0] += x <= y
        state[2] += y <= x
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.sort(i), np.sort(j)


class Aligned:
    """Texts of a chunk, encoded and merged: ids and links of all texts in one row each of arrays, with their bounds."""

    def __init__(self, tool: Vocabularies, told: list[str | None]):
        encoded = tool.encoded(told)
        self.tool = tool
        self.a, self.b = (np.concatenate([x[k] for x in encoded]) for k in (0, 1))
        self.at_a, self.at_b = (np.cumsum([0, *(len(x[k]) for x in encoded)]) for k in (0, 1))
        self.i, self.j = merge(np.cumsum(tool.size_a[self.a]), np.cumsum(tool.size_b[self.b]))
        self.at_link = np.searchsorted(self.i, self.at_a)
        self.pair = tool.links(self.a[self.i], self.b[self.j])

    def text(self, k: int) -> tuple[slice, slice, slice]:
        """Where the ids of A, those of B and the links of text ``k`` are."""
        return tuple(slice(x[k], x[k + 1]) for x in (self.at_a, self.at_b, self.at_link))

    def groups(self, k: int) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups of text ``k``."""
        of_a, of_b, of_link = self.text(k)
        a, b = self.a[of_a], self.b[of_b]
        if not len(a):
            return ""
        i, j = self.i[of_link] - of_a.start, self.j[of_link] - of_b.start
        sizes_a, sizes_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        ends = np.cumsum(sizes_a + sizes_b)  # of each group, A before B
        is_a = np.ones(len(a) + len(b), bool)
        is_a[np.arange(len(b)) + np.repeat(ends - np.cumsum(sizes_b), sizes_b)] = False
        last_a, last_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
        last_a[i], last_b[j] = 1, 1
        code = np.empty(len(is_a), "i8")
        code[is_a] = 2 * a + last_a
        code[~is_a] = 2 * (b + len(self.tool.bytes_a)) + last_b
        return "".join(map(self.tool.spelled.__getitem__, code.tolist()))[:-1]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """(position of the first row, texts) of runs of rows of about ``CHUNK`` bytes; a longer text is a run of its own."""
    held: list[str | None] = []
    first = size = 0
    for at, text in enumerate(texts(batch)):
        if held and size + len(text or "") > CHUNK:
            yield first, held
            held, first, size = [], at, 0
        held.append(text)
        size += len(text or "")
    if held:
        yield first, held


def _mapped(docs: DataFrame, schema: str, path_a: str, path_b: str, told) -> DataFrame:
    """``doc_id`` and what ``told`` makes of text ``k`` of an ``Aligned``, by ``schema``."""

    def run(batch):
        tool = load(path_a, path_b)
        made: dict[str, list] = {"doc_id": batch.column("doc_id")}
        for _, held in chunks(batch):
            aligned = Aligned(tool, held)
            for k in range(len(held)):
                for name, value in told(aligned, k).items():
                    made.setdefault(name, []).append(value)
        return made | {n.split()[0]: made.get(n.split()[0], []) for n in schema.split(", ")}

    return arrow_map(columns(docs, doc_id="bigint", text="string"), f"doc_id bigint, {schema}", run)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b, last_a, last_b) of every document: the ids of both, and the positions of linked tokens.

    Link ``n`` joins token ``last_a[n]`` of A and ``last_b[n]`` of B; both are the last ones of group ``n``, so the groups
    are the runs up to these positions. Null and empty texts, and texts that either tokenizer does not spell byte for byte
    behind a space, have no tokens. Repeated rows are aligned each for itself; a null ``doc_id`` stays null; other columns
    are not read; an empty table gives no rows. Texts of any length are aligned whole.
    """

    def told(x: Aligned, k: int) -> dict:
        of_a, of_b, of_link = x.text(k)
        return {"a": x.a[of_a], "b": x.b[of_b], "last_a": x.i[of_link] - of_a.start, "last_b": x.j[of_link] - of_b.start}

    return _mapped(docs, "a array<int>, b array<int>, last_a array<int>, last_b array<int>", path_a, path_b, told)


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links): figures of every document; ``links`` are the numbers
    of its linked pairs, packed. Rows as those of ``align``; ``groups_sha256`` is empty without tokens."""

    def told(x: Aligned, k: int) -> dict:
        of_a, of_b, of_link = x.text(k)
        groups = x.groups(k)
        n = of_link.stop - of_link.start
        return {
            "n_a": of_a.stop - of_a.start,
            "n_b": of_b.stop - of_b.start,
            "n_groups": n,
            "n_links": n,
            "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
            "links": x.pair[of_link].tobytes(),
        }

    schema = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
    return _mapped(docs, schema, path_a, path_b, told)


def pair_counts(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n): links by numbered pair of ids, from the rows of ``linked``. A task emits each of its pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(load(path_a, path_b).pairs), "i8")
        for batch in batches:
            links = b"".join(x.as_py() for x in batch.column("links"))
            n += np.bincount(np.frombuffer(links, "i4"), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], ["pair", "n"])

    return rows.select("links").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``linked`` without ``links``, with ``n_best`` (links whose pair is the most frequent of its id of B in the whole
    table, ties included) and ``count_sum`` (the pair's count, summed over links).

    The counts have a row for each pair that the vocabularies allow, at most, and are sent to all tasks.
    """
    tool = load(path_a, path_b)
    rows = stored(linked(docs, path_a, path_b), "alignment")
    n = np.zeros(len(tool.pairs), "i8")
    for pair, count in pair_counts(rows, path_a, path_b).collect():
        n[pair] = count
    highest = np.zeros(len(tool.bytes_b), "i8")
    np.maximum.at(highest, tool.b_of_pair, n)
    sent = docs.sparkSession.sparkContext.broadcast((n, n == highest[tool.b_of_pair]))

    def run(batch):
        counts, best = sent.value
        made = {name: batch.column(name) for name in batch.schema.names if name != "links"}
        links = [np.frombuffer(x.as_py(), "i4") for x in batch.column("links")]
        return made | {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(counts[x].sum()) for x in links]}

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return arrow_map(rows, schema, run)
