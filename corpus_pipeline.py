"""From raw documents to token digests: quality rules, near duplicates, benchmark passages, personal data, BPE.

Each stage takes all documents that the one before it kept, and its decisions take effect. All but the last return the
columns of ``documents``; stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vettra.llm import bpe_automaton, decontaminate, hamming_dedup, pii, quality_rules
from vettra.llm.common import stored
from vettra.llm.queries import table, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of a host share.

    Copies are removed only later, so here they do not make their own lines common, and one document keeps each line.
    """
    return quality_rules.cleaned(docs, copies_once=True, first_stays=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return hamming_dedup.deduplicated(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each confirmed span of personal data replaced by its kind."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: the count of ids and the digests of the ids and of the text decoded from them."""
    return bpe_automaton.digests(docs, tokenizer())


STAGES = [
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe", tokens),
]

ORACLE_SQL = None  # SQL expresses neither the groups nor the encoding; a small fixture is held against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
