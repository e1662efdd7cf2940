"""Quality rules: figures of each text, and lines that too many documents of one host share.

Lines are normalised (bytes lower-cased, white space runs as one space) and hashed. For each host and line hash the
distinct documents are counted. A line above the limit, a share of the host's documents but never fewer than a few, is
removed from every document of that host. A document that keeps too small a share of its words is rejected as depleted.

Two options spare copies, for use before near duplicates are removed: ``copies_once`` counts documents with equal whole
texts as one, so that a page copied a thousand times does not make its own lines common, and ``first_stays`` leaves a
common line to the first document that holds it, so that one full member of a group of near copies is left.

Line counts are aggregated before each shuffle (distinct line and text first, then counts), so a line that a third of
all documents hold is a few rows per task. Only lines above the least count meet their host's number of texts, one row a
host; those above the limit are joined back by host and hash.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, stored

SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = b" \t\n\v\f\r"

# A tenth of a host's texts is boilerplate at any table size; its ordinary short lines stay below 5 % (sf0.1).
MAX_DOCS, MAX_SHARE = 5, 0.05

FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean"
)
HELD = f"doc_id bigint, host string, text_hash bigint, {FIGURES}, lines array<struct<line:bigint,words:bigint>>"


def text_figures(text: str, raw: bytes) -> dict:
    """The figures of one text, given as it is and in UTF-8. Words are runs without ASCII white space; lines end at ``\\n``."""
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip(ASCII_SPACE):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + 3 - max(i, until)
                until = i + 3
    return {
        "n_words": n,
        "word_chars": len(text) - len(raw) + len(raw.translate(None, ASCII_SPACE)),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": n < 50 or 100 * repeat > 50 * n,
    }


def measured(docs: DataFrame) -> DataFrame:
    """``HELD`` rows: figures and hashed lines of every document. ``source`` is the host; a null host is a host too."""

    def run(batch):
        import xxhash

        made = []
        for x in batch.column("text"):
            text = x.as_py() or ""
            raw = text.encode()
            row = text_figures(text, raw)
            row["text_hash"] = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
            lines = ((len(words), b" ".join(words)) for words in (line.split() for line in raw.lower().split(b"\n")) if words)
            row["lines"] = [{"line": xxhash.xxh3_64_intdigest(line) - (1 << 63), "words": n} for n, line in lines]
            made.append(row)
        out = {k: [r[k] for r in made] for k in ("text_hash", "lines", *(x.split()[0] for x in FIGURES.split(", ")))}
        return out | {"doc_id": batch.column("doc_id"), "host": batch.column("host")}

    rows = columns(docs.withColumn("host", F.col("source")), doc_id="bigint", host="string", text="string")
    return arrow_map(rows, HELD, run)


def common_lines(held: DataFrame, max_docs: int, max_share: float, copies_once: bool) -> DataFrame:
    """(host, line, first_doc, n_docs): lines that more than ``max_docs`` and ``max_share`` of a host's documents hold.

    Documents are told apart by ``doc_id``, or by their texts if ``copies_once``; null ids are one document.
    """
    document = F.struct("text_hash") if copies_once else F.struct("doc_id")
    lines = held.select("doc_id", "host", document.alias("document"), F.explode("lines.line").alias("line"))
    by_document = lines.groupBy("host", "line", "document").agg(F.min("doc_id").alias("doc_id"))
    by_line = by_document.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    documents = held.select("host", document.alias("document")).distinct()
    hosts = documents.groupBy("host").agg(F.count("*").alias("n"))
    often = by_line.where(F.col("n_docs") > max_docs)
    often = often.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return often.where(F.col("n_docs") > max_share * F.col("n")).drop("n", "of")


def removable(held: DataFrame, key: str, max_docs: int, max_share: float, copies_once: bool, first_stays: bool) -> DataFrame:
    """(key, line, words) of the lines that documents lose."""
    lines = held.select(key, F.col("doc_id").alias("doc"), "host", F.explode("lines").alias("x")).select(key, "doc", "host", "x.*")
    common = common_lines(held, max_docs, max_share, copies_once).select(
        F.col("host").alias("of"), F.col("line").alias("common"), "first_doc"
    )
    # A row of few bytes becomes many lines, and common lines grow with the hosts: never a broadcast of either.
    hit = lines.join(common.hint("merge"), (F.col("line") == F.col("common")) & F.col("host").eqNullSafe(F.col("of")))
    return hit.where(~F.col("doc").eqNullSafe(F.col("first_doc"))) if first_stays else hit


def judge(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    min_left: float = 0.3,
    max_share: float = MAX_SHARE,
    copies_once: bool = False,
    first_stays: bool = False,
) -> DataFrame:
    """One row per document: figures, ``n_removed`` words in removed lines, ``n_common_lines`` and ``kept``.

    A line may be held by ``max_share`` of a host's documents, and by ``max_docs`` of them however few there are.
    ``min_left``: share of words that must be left.
    A document is kept if its figures pass and it is not depleted. Null and empty texts have no words and fail. A null
    ``source`` is a host of its own. Repeated rows are judged alike and count once; rows with a null ``doc_id`` are judged
    too.
    """
    held = stored(measured(docs).withColumn("row", F.monotonically_increasing_id()), "quality-lines")
    hit = removable(held, "row", max_docs, max_share, copies_once, first_stays)
    removed = hit.groupBy("row").agg(F.sum("words").alias("n_removed"), F.count("*").alias("n_common_lines"))
    rows = held.drop("lines", "text_hash", "host").join(removed.hint("merge"), "row", "left")
    left = F.col("n_words") - F.col("n_removed")
    return rows.fillna(0, ["n_removed", "n_common_lines"]).withColumn(
        "kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))
    )


def cleaned(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    min_left: float = 0.3,
    max_share: float = MAX_SHARE,
    copies_once: bool = False,
    first_stays: bool = False,
) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, without their removed lines.

    ``text`` loses whole lines; ``n_chars``, if there, is counted anew where it changed. Here each row is a document of its
    own, also repeated rows and those of one ``doc_id``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
    rows = stored(rows, "quality-docs")
    held = stored(measured(rows.select(F.col("row").alias("doc_id"), "doc.source", "doc.text")), "quality-lines")
    hit = removable(held, "doc_id", max_docs, max_share, copies_once, first_stays)
    removed = hit.groupBy("doc_id").agg(F.sum("words").alias("n_removed"), F.collect_set("line").alias("gone"))
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    kept = held.drop("lines").join(removed.hint("merge"), "doc_id", "left").where(~F.col("base_failed") & (left >= min_left * F.col("n_words")))
    out = rows.join(kept.select(F.col("doc_id").alias("row"), "gone").hint("merge"), "row")
    doc = F.col("doc").withField("text", _without()(F.col("doc.text"), F.col("gone")))
    if "n_chars" in docs.columns:
        counted = F.length(doc.getField("text")).cast(docs.schema["n_chars"].dataType)
        doc = F.when(F.col("gone").isNull(), doc).otherwise(doc.withField("n_chars", counted))
    out = out.select(doc.alias("doc"))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _without():
    """A function of (text, hashes): the text without the lines of these hashes."""
    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        import xxhash

        def line_hash(line: str) -> int:
            return xxhash.xxh3_64_intdigest(b" ".join(line.encode().lower().split())) - (1 << 63)

        def one(t, g):
            if g is None or not len(g):
                return t
            lost = set(g.tolist())
            return "\n".join(line for line in t.split("\n") if line_hash(line) not in lost)

        return pd.Series([one(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)

    return without
