"""Importance resampling towards a target: bucketed word features of both sides, gains per bucket, and a keyed draw.

Words come from the tokenizers library: an untrained pre-tokenizer that splits by a regular expression returns the words
of a text, ASCII-lowered, with their offsets. A feature is a window of words from one offset pair to another, joined by
one space. Its CRC gives its bucket. Both sides are counted by bucket; a bucket's gain says how much likelier it is on
the target side, and a document weighs the sum of its gains. Adding Gumbel noise, keyed by document, to the weights and
taking the highest draws without replacement in proportion to the weights.

Texts are read once: the buckets of every document are stored, two bytes a feature, and both the counts and the weights
are taken from there. Each task of the count emits one row per bucket at most. Gains are one number per bucket, so their
size is fixed by a parameter, whatever the tables hold. Ranks come from a range-dealt table of scores: places within a
part, plus the sizes of the parts before it.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.llm.common import Memo, arrow_map, columns, stored, texts

# Fixed value: characters of a word, once A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 16  # characters handed to the library at once; texts are cut at spaces
MOST_BUCKETS = 1 << 20  # the gains of all buckets travel with each task

_SPACE = re.compile(r"[ \t\n]")


class Features:
    """Texts to words with offsets, and words to buckets."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use every core
        from tokenizers import Regex, pre_tokenizers

        self.sizes, self.buckets = range(shortest, longest + 1), buckets
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str
        self.word_bucket = Memo(lambda w: zlib.crc32(w.encode()) % buckets, 200_000, lambda w: len(w) <= 100)

    def words(self, text: str | None) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """Words of the lowered text with their offsets in the piece they are in, piece by piece."""
        lowered, at = (text or "").encode().lower().decode(), 0
        while at < len(lowered):
            end = len(lowered)
            if end - at > PIECE:
                cut = _SPACE.search(lowered, at + PIECE)
                end = cut.start() if cut else end
            yield self.split(lowered[at:end])
            at = end

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        if self.sizes == range(1, 2):
            found = [self.word_bucket[word] for piece in self.words(text) for word, _ in piece]
            return len(found), np.array(found, "u4")
        words = [word.encode() for piece in self.words(text) for word, _ in piece]
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words], dtype="i8") - 1
        starts = [0, *(ends + 1).tolist()][: len(words)]
        found = [
            zlib.crc32(joined[starts[i] : end]) % self.buckets
            for k in self.sizes
            for i, end in enumerate(ends[k - 1 :].tolist())
        ]
        return len(words), np.array(found, "u4")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(docs: DataFrame, shortest: int, longest: int, buckets: int, **kept: str) -> DataFrame:
    """The ``kept`` columns (name and type), ``n_words``, ``n_features`` and ``buckets``: one number a feature, packed."""
    if not 1 <= buckets <= MOST_BUCKETS or not 1 <= shortest <= longest:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets, and windows of 1 word or more")

    def run(batch):
        tool = Features(shortest, longest, buckets)
        made = [tool.of(text) for text in texts(batch)]
        return {name: batch.column(name) for name in kept} | {
            "n_words": [n for n, _ in made],
            "n_features": [len(x) for _, x in made],
            "buckets": [x.astype(_kind(buckets)).tobytes() for _, x in made],
        }

    schema = ", ".join([*(f"{k} {v}" for k, v in kept.items()), "n_words bigint, n_features bigint, buckets binary"])
    return arrow_map(columns(docs, text="string", **kept), schema, run)


def histogram(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features by bucket. A task sums its rows first and emits each of its buckets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, "i8")
        for batch in batches:
            for x in batch.column("buckets"):
                n += np.bincount(np.frombuffer(x.as_py(), _kind(buckets)), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` for each of the B buckets, from two histograms of at most B rows."""

    def counts(hist: DataFrame) -> np.ndarray:
        n = np.zeros(buckets, "i8")
        for bucket, count in hist.collect():
            n[bucket] = count
        return n

    s, t = counts(corpus), counts(target)
    top, bottom = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = ((y + 1.0) * top / ((x + 1.0) * bottom) for x, y in zip(s.tolist(), t.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], "i8")


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the digest of seed and id (a null id counts as an empty string)."""
    told = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(told.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``features`` with ``weight``, the sum of its features' gains, and ``score``, weight plus noise, for ``buckets``."""
    kind = _kind(len(gain))

    def run(batch):
        weights = [int(gain[np.frombuffer(x.as_py(), kind)].sum()) for x in batch.column("buckets")]
        ids = batch.column("doc_id").to_pylist()
        score = [w + noise(i, seed) for w, i in zip(weights, ids, strict=True)]
        return {n: batch.column(n) for n in ("doc_id", "n_words", "n_features")} | {"weight": weights, "score": score}

    return arrow_map(features, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint", run)


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, 1, 2, 3... in the given order, without bringing them to one task.

    Rows are dealt by ranges, sorted, and written with the part they are in; a part's rows follow those of all parts before
    it. Only one row a part goes through a window without partitions.
    """
    part, inside = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("inside")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, inside)
    dealt = stored(dealt, "placed")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("inside").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("inside") - F.col("first") + 1
    return dealt.join(sizes, "part").select(*[f"`{c}`" for c in rows.columns], place.alias("place"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = 10_000,
    shortest: int = 1,
    longest: int = 1,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Features are windows of ``shortest`` to ``longest`` words of ``text``, in both tables. Of the documents with at least
    ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn: the highest scores, ties to the smaller
    ``doc_id``, a null ``doc_id`` last. Null, empty and wordless texts have no features and weigh 0. Repeated rows are
    separate documents; those of one ``doc_id`` and score rank by weight, then in any order. An empty target gives
    each bucket a gain against a uniform target; an empty table gives no rows. Other columns are not read.
    """
    features = stored(featured(docs, shortest, longest, buckets, doc_id="bigint"), "features")
    wanted = histogram(featured(target, shortest, longest, buckets), buckets)
    gain = gains(histogram(features, buckets), wanted, buckets)
    rows = stored(scored(features, gain, seed).withColumn("open", F.col("n_words") >= least_words), "scores")
    drawn = rows.agg(F.count_if("open").alias("n")).first().n * percent // 100
    id_last = F.col("doc_id").asc_nulls_last()
    ordered = placed(
        rows.withColumn("row", F.monotonically_increasing_id()),
        F.desc("open"), F.desc("score"), id_last, F.desc("weight"), F.col("row"),
    )
    rank = F.when(F.col("open") & (F.col("place") <= drawn), F.col("place"))
    return ordered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
