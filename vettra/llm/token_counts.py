"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by encoded length; the histogram has one row per distinct length, never one per document. Suffix
sums over it give, for each limit L: documents and tokens that reach L, and the tokens left when each document is cut
at L. Sums run in two levels (within blocks of lengths, then over blocks), so no single task holds the histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, texts
from vettra.llm.library_encoder import encoder

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``n_tokens`` of every row of ``docs``; null and empty texts count 0."""

    def run(batch):
        tool = encoder(tokenizer)
        return {"n_tokens": [len(tool.encode(t)) // 4 for t in texts(batch)]}

    return arrow_map(columns(docs, text="string"), "n_tokens bigint", run)


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents by length; rows with a null length do not count."""
    return counted.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a limit:

    ``docs_up_to``     documents of at most L tokens
    ``docs_from``      documents of at least L tokens
    ``tokens_from``    tokens of those
    ``truncated``      tokens left when every document is cut at L
    ``quantile``       share of documents of at most L tokens: L is the smallest q-quantile for q up to this share
                       and above that of the next smaller length
    An empty table gives no rows.
    """
    sums = {"docs": F.col("n_docs"), "tokens": F.col("n_docs") * F.col("n_tokens")}
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    over = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"{k}_above") for k in sums],
        *[F.sum(k).over(every).alias(f"{k}_all") for k in sums],
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(x).over(within).alias(f"{k}_within") for k, x in sums.items()]).join(blocks, "block")
    rows = rows.select("*", *[(F.col(f"{k}_within") + F.col(f"{k}_above")).alias(f"{k}_from") for k in sums])
    below = F.col("tokens_all") - F.col("tokens_from")
    up_to = F.col("docs_all") - F.col("docs_from") + F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", up_to.alias("docs_up_to"), "docs_from", "tokens_from",
        (below + F.col("docs_from") * F.col("n_tokens")).alias("truncated"),
        (up_to / F.col("docs_all")).alias("quantile"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share ``q`` of documents do not exceed (one row; none for no documents)."""
    return answers.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens IS NOT NULL")


def truncated(answers: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at ``limit``, for any limit (one row; null for no documents)."""
    up = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "truncated", "docs_from", "n_docs")))
    x = answers.agg(up.alias("x"), F.max("docs_from").alias("docs"))
    more = (F.col("x.docs_from") - F.col("x.n_docs")) * (limit - F.col("x.n_tokens"))
    return x.select(F.coalesce(F.col("x.truncated") + more, F.col("docs") * limit).cast("bigint").alias("truncated"))
