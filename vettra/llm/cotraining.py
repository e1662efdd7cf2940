"""Quality classifier by co-training of two views.

One classifier sees what a text says (its words and the shapes of its words), the other what is known about the page
(source, language, length). In each round both score the whole table; each tells the other the documents it is surest
of. What a view learns from them is of two kinds: its features are chosen anew by counts over *all* documents the other
view is sure of, and its weights are fitted on labelled documents and a bounded sample of told ones. Both are then
calibrated on labelled documents kept apart, a small model fitted on others kept apart joins the calibrated views, and
every document is scored.

A document is good when ``quality`` is 1 and ``toxic`` is not. Bounds, chosen by a hash of the id: ``max_labelled``
labelled documents, and ``max_told`` documents for each view, class and round. Sure documents with a label never become
cases, but they are among the counts, as leaving them out would move whole texts through a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, stored

BUCKETS = 1 << 18
TOLD_WEIGHT = 0.3  # of a document that the other view labelled
_CORE = re.compile(r"^\W+|\W+$")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # odd, 2**64 over the golden ratio
_LETTERS = [chr(b) for b in range(256)]
_WORD_BYTE = np.array([c.isascii() and (c.isalnum() or c == "_") for c in _LETTERS])
_LOWER = np.array([ord(c.lower()) if c.isascii() else ord(c) for c in _LETTERS], "u1")
_KIND = _LOWER.copy()
for _first, _last in ("AZ", "az", "09"):
    _KIND[ord(_first) : ord(_last) + 1] = ord(_first)


def shape(word: str) -> str:
    """A word's form: upper case, lower case and digits as one sign a run; other characters stay."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return "".join(kind for kind, _ in groupby(kinds))


def _buckets(data: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A polynomial hash of each run of bytes, mixed, as a bucket."""
    end = np.cumsum(lengths)
    place = np.arange(len(data)) - np.repeat(end - lengths, lengths)
    powers = np.cumprod(np.full(lengths.max(initial=0), GOLDEN, "u8"))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((data.astype("u8") + np.uint64(1)) * powers[place], dtype="u8")])
    h = sums[end] - sums[end - lengths] + np.uint64(seed)
    h = (h ^ h >> np.uint64(29)) * GOLDEN
    return ((h ^ h >> np.uint64(32)) % np.uint64(BUCKETS)).astype("i8")


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings that is no slice, and the length of each."""
    lengths = np.asarray(pc.binary_length(words)).astype("i8")
    return np.frombuffer(words.buffers()[2] or b"", "u1")[: lengths.sum()], lengths


def word_buckets(words: pa.Array) -> np.ndarray:
    """(words, 2): buckets of the bare lower-case word and of its shape. ASCII words are worked out together."""
    out = np.zeros((len(words), 2), "i8")
    plain = np.asarray(pc.string_is_ascii(words))
    data, lengths = _bytes(pc.filter(words, pa.array(plain)))
    end, word = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths)
    seen = np.concatenate([[0], np.cumsum(_WORD_BYTE[data])])
    before, after = seen[(end - lengths)[word]], seen[end[word]]
    inside = (seen[1:] > before) & (seen[:-1] < after)  # from the first to the last word byte
    kind = _KIND[data]
    turn = np.ones(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])
    for column, (value, keep) in enumerate(((_LOWER[data], inside), (kind, turn))):
        out[plain, column] = _buckets(value[keep], np.bincount(word[keep], minlength=len(lengths)), column)
    rest = pc.filter(words, pa.array(~plain)).to_pylist()
    for column, made in enumerate(([_CORE.sub("", w).lower() for w in rest], [shape(w) for w in rest])):
        out[~plain, column] = _buckets(*_bytes(pa.array(made, pa.string())), column)
    return out


def word_features(word: str) -> tuple[int, int]:
    """``word_buckets`` of one word."""
    return tuple(word_buckets(pa.array([word]))[0].tolist())


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of what is known about the page."""
    import xxhash

    size = "none" if n_chars is None else str(int(2 * np.log2(max(1, n_chars))))
    told = (f"source {source}", f"lang {lang}", f"size {size}", f"lang-size {lang} {size}")
    return sorted({xxhash.xxh3_64_intdigest(x) % BUCKETS for x in told})


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most_bytes`` of text, so that memory depends on the longest text alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype("i8")
    begin, held = 0, 0
    for i, more in enumerate(size):
        if i > begin and (held + more > most_bytes or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += more
    if begin < len(size):
        yield batch.slice(begin)


@dataclass
class Words:
    """The words of a run of documents: each one's document, its two buckets, and which documents have no word."""

    doc: np.ndarray
    buckets: np.ndarray
    blank: np.ndarray

    @classmethod
    def of(cls, text: pa.Array) -> Words:
        split = pc.utf8_split_whitespace(pc.fill_null(text, ""))
        doc = np.repeat(np.arange(len(text)), np.asarray(pc.list_value_length(split)))
        coded = split.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        table = word_buckets(coded.dictionary)
        real = np.asarray(pc.binary_length(coded.dictionary))[code] > 0
        blank = np.ones(len(text), bool)
        blank[doc[real]] = False
        return cls(doc[real], table[code[real]], blank)

    def sets(self, chosen: np.ndarray) -> np.ndarray:
        """Document << 32 | bucket for the distinct buckets of the chosen documents, in order."""
        use = chosen[self.doc]
        return np.unique(((self.doc[use] << 32)[:, None] | self.buckets[use]).ravel())


@dataclass
class Linear:
    """Logistic regression on chosen buckets, and its calibration (slope and shift of the logit)."""

    column: dict[int, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    shift: float = 0.0

    def matrix(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.column) + 1), "f4")
        x[:, -1] = 1
        for i, row in enumerate(rows):
            found = [self.column[b] for b in row if b in self.column]
            x[i, found] = 1
        return x

    def hits(self, words: Words) -> np.ndarray:
        """``matrix`` of a run of documents."""
        place = np.full(BUCKETS, -1)
        place[list(self.column)] = list(self.column.values())
        x = np.zeros((len(words.blank), len(self.column) + 1), "f4")
        x[:, -1] = 1
        for at in words.buckets.T:
            column = place[at]
            x[words.doc[column >= 0], column[column >= 0]] = 1
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.weights = logistic(x, y, weight)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) * self.slope + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        raw = self.logit(x)
        slope, self.shift = map(float, logistic(np.stack([raw, np.ones_like(raw)], 1), y))
        self.slope = max(slope, 0.0)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton steps; both classes weigh the same if ``weight`` is not given."""
    w = np.zeros(x.shape[1])
    x = x.astype("f8")
    if weight is None:
        weight = np.ones(len(y))
    for _ in range(12):
        p = sigmoid(x @ w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Counts:
    """How many documents there are, how many are good, and both by bucket."""

    n: float
    good: float
    total: np.ndarray
    hits: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], y: np.ndarray) -> Counts:
        seen = np.concatenate([*rows, np.zeros(0, "i8")]).astype("i8")
        label = np.repeat(y, [len(r) for r in rows])
        total = np.bincount(seen, minlength=BUCKETS).astype("f8")
        return cls(len(y), float(y.sum()), total, np.bincount(seen, weights=label, minlength=BUCKETS))

    def with_told(self, told: Counts) -> Counts:
        """Told documents added, at ``TOLD_WEIGHT`` each and never outweighing the labelled ones."""
        w = min(TOLD_WEIGHT, self.n / max(1.0, told.n))
        return Counts(self.n + w * told.n, self.good + w * told.good, self.total + w * told.total, self.hits + w * told.hits)


def telling(counts: Counts, most: int, least_score: float = 12.0) -> dict[int, int]:
    """The buckets whose presence depends most on the class (chi-square above ``least_score``), at most ``most``."""
    n, good, total, hits = counts.n, counts.good, counts.total, counts.hits
    spread = total * (n - total) * good * (n - good)
    score = np.divide(n * (n * hits - total * good) ** 2, spread, out=np.zeros(BUCKETS), where=spread > 0)
    best = np.argsort(-score, kind="stable")[:most]
    return {int(b): i for i, b in enumerate(best[score[best] > least_score])}


@dataclass
class Cases:
    """Documents to learn from: the buckets of both views, and the class."""

    content: list[np.ndarray]
    page: list[np.ndarray]
    y: np.ndarray

    def __getitem__(self, rows: np.ndarray) -> Cases:
        return Cases([self.content[i] for i in rows], [self.page[i] for i in rows], self.y[rows])

    @property
    def views(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return self.content, self.page


@dataclass
class Model:
    content: Linear
    page: Linear
    joint: np.ndarray  # weights of the two calibrated logits, and a shift

    @property
    def views(self) -> tuple[Linear, Linear]:
        return self.content, self.page


def teach(known: Cases, told: list[tuple[Counts, Cases]], most: int) -> Model:
    """Both views fitted on labelled cases and on what the other view told each, calibrated and joined.

    Of ten labelled cases one calibrates, another fits the weights of the joint score, the others teach.
    """
    place = np.arange(len(known.y)) % 10
    taught, calibrate, join = known[np.flatnonzero(place > 1)], known[np.flatnonzero(place == 0)], known[np.flatnonzero(place == 1)]
    views = []
    for k, (counts, more) in enumerate(told):
        own = Counts.of(taught.views[k], taught.y)
        view = Linear(telling(own.with_told(counts), most))
        weight = np.concatenate([np.ones(len(taught.y)), np.full(len(more.y), TOLD_WEIGHT)])
        view.fit(view.matrix(taught.views[k] + more.views[k]), np.concatenate([taught.y, more.y]), weight)
        view.calibrate(view.matrix(calibrate.views[k]), calibrate.y)
        views.append(view)
    logits = [view.logit(view.matrix(join.views[k])) for k, view in enumerate(views)]
    return Model(*views, logistic(np.stack([*logits, np.ones(len(join.y))], 1), join.y))


INPUT = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
NOBODY = Cases([], [], np.zeros(0))


def _pages(batch: pa.RecordBatch) -> list[list[int]]:
    cells = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)
    return [page_features(*cell) for cell in cells]


def _share(name: str, most: int, n: int) -> Column:
    """About ``most`` of ``n`` rows, by a hash of the id."""
    return F.pmod(F.xxhash64(name), F.lit(1_000_000)) < F.lit(min(1_000_000, most * 1_000_000 // max(1, n)))


def _cases(docs: DataFrame, ids: DataFrame) -> list[Cases]:
    """The cases of ``ids`` (view, label_id, good), for each view. Of rows of one id the smallest text counts.

    ``ids`` are few by a documented bound, so they are sent to the documents, which are not shuffled.
    """
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).groupBy("view", "doc_id", "good")
    once = found.agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("x")).select("view", "doc_id", "good", "x.*")

    def run(batch):
        content = []
        for part in slices(batch):
            sets = Words.of(part.column("text")).sets(np.ones(part.num_rows, bool))
            cut = np.searchsorted(sets >> 32, np.arange(1, part.num_rows))
            content += np.split((sets & 0xFFFFFFFF).astype("i4"), cut)
        kept = {name: batch.column(name) for name in ("view", "doc_id", "good")}
        return kept | {"content": content, "page": _pages(batch)}

    made = arrow_map(once, "view int, doc_id bigint, good int, content array<int>, page array<int>", run)
    got = made.toArrow().sort_by([("good", "descending"), ("doc_id", "ascending")])
    cases = []
    for view in (0, 1):
        own = got.filter(pc.equal(got.column("view"), view))
        lists = []
        for name in ("content", "page"):
            whole = own.column(name).combine_chunks()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(whole), 0))
            lists.append(np.split(np.asarray(whole.flatten()).astype("i8"), np.cumsum(lengths)[:-1]) if len(whole) else [])
        cases.append(Cases(*lists, np.asarray(own.column("good")).astype("f8")))
    return cases


SURE = "view int, good int, doc_id bigint, bucket int, n bigint"


def sure(docs: DataFrame, model: Model, doubt: float) -> DataFrame:
    """What each view tells the other about the whole table, in one pass.

    Rows with a ``doc_id`` are documents of which the other view is sure (its calibrated chance is under ``doubt`` or
    over 1 - ``doubt``). Rows with a ``bucket`` count those documents by the learning view's buckets, one row per task
    and bucket. ``view`` is the one that learns. Blank texts and rows without an id tell nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value.views
        counts = np.zeros((2, 2, BUCKETS), "i8")
        kind = pa.schema([("view", pa.int32()), ("good", pa.int32()), ("doc_id", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64())])

        def rows(view: int, good: int, doc_id: pa.Array | None, bucket: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
            size = len(bucket) if doc_id is None else len(doc_id)
            cells = [np.full(size, view), np.full(size, good), doc_id, bucket, n]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(size, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cells, kind, strict=True)], schema=kind
            )

        for batch in batches:
            for part in slices(batch):
                words, pages = Words.of(part.column("text")), _pages(part)
                able = ~words.blank & np.asarray(part.column("doc_id").is_valid())
                chances = [sigmoid(views[0].logit(views[0].hits(words))), sigmoid(views[1].logit(views[1].matrix(pages)))]
                for view in (0, 1):
                    p = chances[1 - view]
                    for good, told in enumerate((able & (p < doubt), able & (p > 1 - doubt))):
                        at = np.flatnonzero(told)
                        if not len(at):
                            continue
                        seen = words.sets(told) & 0xFFFFFFFF if view == 0 else np.concatenate([pages[i] for i in at])
                        counts[view, good] += np.bincount(seen, minlength=BUCKETS)
                        yield rows(view, good, part.column("doc_id").take(pa.array(at)), None, None)
        for view, good in np.ndindex(2, 2):
            bucket = np.flatnonzero(counts[view, good])
            yield rows(view, good, None, bucket, counts[view, good][bucket])

    return docs.mapInArrow(run, SURE)


def _told(docs: DataFrame, labels: DataFrame, model: Model, doubt: float, most: int) -> list[tuple[Counts, Cases]]:
    """For each view: the counts over all documents that the other view is sure of, and a sample of them as cases."""
    told = stored(sure(docs, model, doubt), "op1-sure")
    sizes = {(r.view, r.good): r.n for r in told.where("doc_id IS NOT NULL").groupBy("view", "good").agg(F.count("*").alias("n")).collect()}
    hits = np.zeros((2, 2, BUCKETS))
    summed = told.where("bucket IS NOT NULL").groupBy("view", "good", "bucket").agg(F.sum("n").alias("n")).toArrow()
    hits[tuple(np.asarray(summed.column(c)) for c in ("view", "good", "bucket"))] = np.asarray(summed.column("n"))
    chance = F.lit(False)
    for (view, good), n in sizes.items():
        chance = chance | ((F.col("view") == view) & (F.col("good") == good) & _share("doc_id", most, n))
    ids = told.where(F.col("doc_id").isNotNull() & chance).groupBy("view", F.col("doc_id").alias("label_id")).agg(F.min("good").alias("good"))
    cases = _cases(docs, ids.join(labels.select("label_id"), "label_id", "left_anti"))
    counts = []
    for view in (0, 1):
        bad, good = (sizes.get((view, g), 0) for g in (0, 1))
        counts.append(Counts(bad + good, good, hits[view].sum(0), hits[view, 1]))
    return list(zip(counts, cases, strict=True))


SCORED = "doc_id bigint, content_score double, page_score double, score double"


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``SCORED`` for every document. Null, empty and blank texts score 0; without a model every score is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few thousand weights

    def run(batch):
        m, n = shared.value, batch.num_rows
        if m is None:
            return {"doc_id": batch.column("doc_id"), "content_score": [None] * n, "page_score": [None] * n, "score": [None] * n}
        content, blank = [np.zeros(0)], [np.zeros(0, bool)]
        for part in slices(batch):
            words = Words.of(part.column("text"))
            content.append(m.content.logit(m.content.hits(words)))
            blank.append(words.blank)
        content, blank = np.concatenate(content), np.concatenate(blank)
        page = m.page.logit(m.page.matrix(_pages(batch)))
        score = np.where(blank, 0.0, sigmoid(m.joint[0] * content + m.joint[1] * page + m.joint[2]))
        return {"doc_id": batch.column("doc_id"), "content_score": sigmoid(content), "page_score": sigmoid(page), "score": score}

    return arrow_map(columns(docs, **INPUT), SCORED, run)


def classify(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000, max_told: int = 1_000, rounds: int = 3, most: int = 400
) -> DataFrame:
    """``SCORED`` and ``kept`` (score of 0.5 or more) for every document.

    With no labelled document, or labels of one class only, scores are null and all are kept. Labels of one id that
    differ count as the worse one. Repeated rows give repeated rows. The doubt allowed grows from round to round, up to
    a chance of 0.05; a view that is never so sure tells the other nothing.
    """
    rows = columns(docs, **INPUT)
    known = columns(labels, doc_id="bigint", quality="int", toxic="int").withColumnRenamed("doc_id", "label_id")
    known = known.where("label_id IS NOT NULL AND quality IS NOT NULL").groupBy("label_id")
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1)
    known = known.agg(good.cast("int").alias("good"))
    cases = _cases(rows, known.where(_share("label_id", max_labelled, known.count())).withColumn("view", F.lit(0)))[0]
    model = None
    if {0, 1} <= set(cases.y[2:].tolist()):
        model = teach(cases, [(Counts(0, 0, np.zeros(BUCKETS), np.zeros(BUCKETS)), NOBODY)] * 2, most)
        for turn in range(rounds):
            model = teach(cases, _told(rows, known, model, 0.05 * (turn + 1) / rounds, max_told), most)
    return scores(docs, model).withColumn("kept", F.coalesce(F.col("score") >= 0.5, F.lit(True)))
