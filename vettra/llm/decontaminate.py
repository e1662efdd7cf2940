"""Benchmark decontamination by a generalised suffix automaton over the items' words.

The automaton accepts every run of words of every test item. Each document is streamed through it once; the state holds
the longest run of words, ending here, that some item contains. A run of at least ``window`` words, or a whole shorter
item, is a hit. Spans of hits are removed; a document that is hit over too large a share is rejected.

The items are read to the driver in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast is bounded however
large the benchmark is; documents pass each block's automaton in turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, packed, stored, texts, unpacked

BLOCK_WORDS = 100_000  # an automaton of so many words takes some 100 MB
PASSES = 2  # automata in one stage; what they give is stored before the next

# Every byte that is no word byte becomes a space once letters are lower case.
_BLANK = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words before letters are lower case


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, ASCII letters and anything beyond ASCII."""
    return (text or "").encode().lower().translate(_BLANK).split()


@dataclass
class SuffixAutomaton:
    """States by number: transitions by word, suffix link, longest length; and what a window that ends there tells."""

    window: int
    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set[int | None]] = field(default_factory=dict)  # by the state of a whole window
    short: dict[int, list[tuple[int, int | None]]] = field(default_factory=dict)  # (length, item) of shorter items

    def _state(self, like: int | None, length: int, link: int) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, of: int, above: int, word: bytes) -> int:
        """Split the runs of ``of`` that ``above`` can reach off into a state of their own."""
        copy = self._state(of, self.length[above] + 1, self.link[of])
        self.link[of] = copy
        while above >= 0 and self.next[above].get(word) == of:
            self.next[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the run of ``last`` and ``word``."""
        there = self.next[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(there, last, word)
        new = self._state(None, self.length[last] + 1, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._clone(there, last, word)
        return new

    def build(self, items: list[tuple[int | None, list[bytes]]]) -> SuffixAutomaton:
        for _, run in items:
            last = 0
            for word in run:
                last = self._extend(last, word)
        n = len(self.next)
        # The state of the last `window` words of a longer run, and the nearest states above with a shorter item.
        order = sorted(range(n), key=self.length.__getitem__)
        self.whole = [-1] * n
        for v in order[1:]:
            up = self.link[v]
            self.whole[v] = -1 if self.length[v] < self.window else v if self.length[up] < self.window else self.whole[up]
        for item, run in items:
            if not run:
                continue
            v = 0
            for i, word in enumerate(run):
                v = self.next[v][word]
                if i + 1 >= self.window:
                    self.items.setdefault(self.whole[v], set()).add(item)
            if len(run) < self.window:
                while self.length[self.link[v]] >= len(run):
                    v = self.link[v]
                self.short.setdefault(v, []).append((len(run), item))
        self.above = [-1] * n
        for v in order[1:]:
            up = self.link[v]
            self.above[v] = up if up in self.short else self.above[up]
        self.telling = [w >= 0 or v in self.short or a >= 0 for v, (w, a) in enumerate(zip(self.whole, self.above, strict=True))]
        self.least = min([self.window, *(k for x in self.short.values() for k, _ in x)])
        return self

    def hits(self, run: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (first word, word behind the last), joined where they touch or overlap, and the items found that have an id."""
        nexts, link, length, telling, least = self.next, self.link, self.length, self.telling, self.least
        spans: list[tuple[int, int]] = []
        found: set[int | None] = set()
        state = run_length = 0
        root = nexts[0]
        for i, word in enumerate(run):
            there = nexts[state].get(word)
            if there is None:
                if word not in root:
                    state = run_length = 0
                    continue
                while there is None:
                    state = link[state]
                    there = nexts[state].get(word)
                run_length = length[state]
            state = there
            run_length += 1
            if run_length >= least and telling[state]:
                longest = self._tell(state, run_length, found)
                if longest:
                    begin = i + 1 - longest
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, found - {None}

    def _tell(self, state: int, run_length: int, found: set[int | None]) -> int:
        longest = 0
        if run_length >= self.window:
            found |= self.items[self.whole[state]]
            longest = run_length
        for k, item in self.short.get(state, ()):
            if k <= run_length:
                found.add(item)
                longest = max(longest, k)
        up = self.above[state]
        while up >= 0:
            for k, item in self.short[up]:
                found.add(item)
                longest = max(longest, k)
            up = self.above[up]
        return longest


def automata(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS):
    """Broadcast automata, one per block of items of at most ``block_words`` words (or one single longer item).

    Items are dealt to blocks by hash; the number of blocks follows from the total. Null and empty items have no window;
    items with a null ``item_id`` give hits but no id, and items of one id count as one.
    """
    spark = benchmark.sparkSession
    items = columns(benchmark, item_id="bigint", text="string").where("text IS NOT NULL")
    size = F.length("text")  # characters: an upper bound of the words, twice over
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = [(r.item_id, words(r.text)) for r in block.toLocalIterator()]
        rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield spark.sparkContext.broadcast(SuffixAutomaton(window).build(rows))


SPANS = "spans array<struct<begin:int,end:int>>"
NONE = f"CAST(array() AS {SPANS.split(' ')[1]})"


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, items, spans), spans by word number.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Repeated rows give repeated rows.
    """
    rows = columns(docs, doc_id="bigint", text="string")
    state = rows.selectExpr("doc_id", "text", "0L AS n_words", "CAST(array() AS array<bigint>) AS items", f"{NONE} AS spans")
    schema = f"doc_id bigint, text string, n_words bigint, items array<bigint>, {SPANS}"

    def through(automaton):
        def run(batch):
            made = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": [], "items": [], "spans": []}
            before = zip(batch.column("items"), batch.column("spans"), strict=True)
            for text, (items, spans) in zip(texts(batch), before, strict=True):
                run = words(text)
                new, found = automaton.value.hits(run)
                old = [(x["begin"], x["end"]) for x in spans.as_py()]
                made["n_words"].append(len(run))
                made["items"].append(sorted(found.union(items.as_py())))
                made["spans"].append([{"begin": a, "end": b} for a, b in united(old + new)])
            return made

        return run

    state = passed(state, automata(benchmark, window, block_words), lambda a: (schema, through(a)))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x.end - x.begin)
    return state.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def passed(state: DataFrame, blocks, step) -> DataFrame:
    """``state`` through each automaton in turn, with at most ``PASSES`` of them loaded in a task."""
    for i, automaton in enumerate(blocks):
        if i and i % PASSES == 0:
            state = stored(state, "decontaminated")
        state = arrow_map(state, *step(automaton))
    return state


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them; a line end marks each gap."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return "\n".join(out)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents without benchmark passages, with all their columns.

    Spans are cut until none is left; a document that loses more than ``max_share`` of its words is dropped. Documents
    without a hit pass untouched, null and empty ones too. A cut may join words to a passage of another block of items,
    so with several blocks the documents that were cut go through all of them again until none is.
    """
    state = packed(docs).selectExpr("rest", "text", "0L AS n_words", "0L AS n_hit", "0L AS before")

    def through(automaton):
        def run(batch):
            made = {"rest": batch.column("rest"), "before": batch.column("before"), "text": [], "n_words": [], "n_hit": []}
            for text, n, hit in zip(texts(batch), batch.column("n_words"), batch.column("n_hit"), strict=True):
                run, lost = words(text), 0
                total = n.as_py() or len(run)
                while spans := automaton.value.hits(run)[0]:
                    lost += sum(b - a for a, b in spans)
                    text = cut(text, spans)
                    run = words(text)
                made["text"].append(text)
                made["n_words"].append(total)
                made["n_hit"].append(hit.as_py() + lost)
            return made

        return run

    schema = state.schema
    blocks = list(automata(benchmark, window, block_words))

    def once(state: DataFrame) -> DataFrame:
        state = passed(state, blocks, lambda a: (schema, through(a)))
        return state.where(F.col("n_hit") <= max_share * F.col("n_words"))

    kept = once(state)
    if len(blocks) > 1:
        rounds = []
        while True:
            now = stored(kept, "decontaminated")
            rounds.append(now.where("n_hit = before"))
            again = now.where("n_hit > before").withColumn("before", F.col("n_hit"))
            if again.isEmpty():
                break
            kept = once(again)
        kept = reduce(DataFrame.unionAll, rounds)
    return unpacked(kept, docs, F.col("n_hit") > 0)
