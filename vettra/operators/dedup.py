"""Idempotency and uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.constants import LIST_CHANGES, LIST_ORDER, SCREENING_STATUSES, SEVERITY, SOURCES


def _placed_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row per key. Spark limits each group before the shuffle, so a hot key moves one row per task."""
    return _placed_first(rows, keys, [F.col(c).asc() for c in order])


def last_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Latest row per key, ties broken by the later order columns."""
    return _placed_first(rows, keys, [F.col(c).desc() for c in order])


def seen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``rows`` that are stored already.

    The stored history is filtered by the batch's keys, so where the batch is small enough to broadcast the history is
    scanned but never shuffled.
    """
    return stored.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")


def unprocessed(messages: DataFrame, idempotency: DataFrame, *order: str) -> DataFrame:
    """Messages whose key was not processed before, each once."""
    keys = ["message_key"]
    once = first_of(messages, keys, *order) if order else messages.dropDuplicates(keys)
    processed = idempotency.select(F.col("key").alias("message_key"))
    return once.join(seen(once, processed, keys), keys, "left_anti")


def new_profiles(normalized: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """One normalized row per (client_id, profile_hash): the first to arrive, unless one is stored."""
    keys = ["client_id", "profile_hash"]
    first = first_of(normalized, keys, *order)
    return first.join(seen(first, stored, keys), keys, "left_anti")


def new_for_screening(rows: DataFrame, stored: DataFrame, *order: str) -> DataFrame:
    """One row per screening, whatever the number of messages, and none where one is stored."""
    keys = ["screening_id"]
    first = first_of(rows, keys, *order) if order else rows.dropDuplicates(keys)
    return first.join(seen(first, stored, keys), keys, "left_anti")


def _in(column: str, allowed: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(allowed), F.lit(False))


DOMAINS = {
    "raw_profile": lambda: {"source": _in("source", SOURCES)},
    "watchlist_entry": lambda: {"list_type": _in("list_type", LIST_ORDER)},
    "watchlist_update": lambda: {"list_type": _in("list_type", LIST_ORDER), "change": _in("change", LIST_CHANGES)},
    "screening": lambda: {"status": _in("status", SCREENING_STATUSES)},
    "match": lambda: {
        "list_type": _in("list_type", LIST_ORDER),
        "score": F.coalesce((F.col("score") >= 0) & (F.col("score") <= 1), F.lit(False)),
    },
    "decision": lambda: {"outcome": _in("outcome", list(SEVERITY))},
    "reconciliation_run": lambda: {"list_type": _in("list_type", LIST_ORDER)},
}


def check_domains(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into those within the table's domains and violators with the failed column names."""
    rules = DOMAINS[table]()
    failed = F.filter(
        F.array(*[F.when(~ok, F.lit(column)) for column, ok in rules.items()]), lambda c: c.isNotNull()
    )
    ok = reduce(lambda a, b: a & b, rules.values())
    return rows.where(ok), rows.where(~ok).withColumn("failed_checks", failed)
