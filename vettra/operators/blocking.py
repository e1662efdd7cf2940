"""Candidate lookup: which list entries share a first letter with a query name, how many, and the first page.

All steps work on distinct *sets of first letters*, not on rows. There are few such sets however many profiles carry
them, so a name shared by a third of all clients costs one row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vettra.constants import LOOKUP_PAGE
from vettra.functions import names
from vettra.operators.lists import entry_letters
from vettra.session import stored

ROW_BITS = 33  # of a generated row number, below the task's


def with_letters(profiles: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Add ``letters``, the sorted first letters of a name, as one string key."""
    return profiles.withColumn("letters", F.array_join(names.canonical_letters(F.col(name)), ""))


def _letters_of(sets: DataFrame) -> DataFrame:
    return sets.select("letters", F.explode(F.split("letters", "")).alias("letter")).where("letter <> ''")


def letter_index(entries: DataFrame) -> DataFrame:
    """(provider_id, letter, bucket, bits): the entries with a letter, as bitmaps of 32,768 entries each.

    Bits need dense numbers. A writing task numbers its own rows; the numbers are read back from its file, so a task that
    runs again cannot shift them, and a running sum over the tasks' counts (one row a task) closes the gaps.
    """
    kept = stored(
        entries.select("provider_id", entry_letters(entries).alias("entry_letters"), F.monotonically_increasing_id().alias("id")),
        "entry-letters",
    )
    kept = kept.withColumn("task", F.shiftright("id", ROW_BITS))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = kept.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("task", F.coalesce(before, F.lit(0)).alias("start"))
    in_task = F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = kept.join(starts, "task").withColumn("number", F.col("start") + in_task + 1)
    return (
        numbered.select("provider_id", "number", F.explode("entry_letters").alias("letter"))
        .groupBy("provider_id", "letter", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    )


def candidate_totals(letter_sets: DataFrame, entries: DataFrame) -> DataFrame:
    """(letters, provider_id, total): entries that share a letter, before any page is cut.

    A set's candidates are the union of its letters' bitmaps: query sets never meet entries or their letter sets.
    """
    met = _letters_of(letter_sets.select("letters").distinct()).join(letter_index(entries).hint("merge"), "letter")
    return (
        met.groupBy("letters", "provider_id", "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
        .groupBy("letters", "provider_id")
        .agg(F.sum("n").alias("total"))
    )


def candidate_pages(letter_sets: DataFrame, entries: DataFrame, limit: int = LOOKUP_PAGE) -> DataFrame:
    """(letters, provider_id, list_type, entry_id): the first ``limit`` candidates by entry id per provider.

    An entry on the page of a letter set is among the first ``limit`` entries of at least one of its letters, so it
    is enough to merge the per-letter heads: at most ``limit`` rows per letter and provider, whatever the list size.
    """
    by_entry = Window.partitionBy("provider_id", "letter").orderBy("entry_id")
    heads = (
        entries.select("provider_id", "list_type", "entry_id", F.explode(entry_letters(entries)).alias("letter"))
        .withColumn("rn", F.row_number().over(by_entry))
        .where(F.col("rn") <= limit)
        .drop("rn")
    )
    merged = (
        _letters_of(letter_sets.select("letters").distinct())
        .join(heads, "letter")
        .select("letters", "provider_id", "list_type", "entry_id")
        .distinct()
    )
    page = Window.partitionBy("letters", "provider_id").orderBy("entry_id")
    return merged.withColumn("rank", F.row_number().over(page)).where(F.col("rank") <= limit)
