"""Screen profiles against the lists: lookups, matches and one screening row per profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fields
from vettra.operators import blocking, simjoin
from vettra.operators.lists import ProviderState, available, entry_names


@dataclass(frozen=True)
class Screened:
    lookup: DataFrame
    match: DataFrame
    screening: DataFrame


def _providers(state: list[ProviderState]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.provider_id).alias("provider_id"),
                F.lit(s.list_type).alias("list_type"),
                F.lit(s.list_version).alias("list_version"),
                F.lit(s.degraded).alias("degraded"),
            )
            for s in state
        ]
    )


def list_versions(state: list[ProviderState]) -> Column:
    return F.create_map(*[F.lit(x) for s in state for x in (s.provider_id, s.list_version)])


def lookups(
    profiles: DataFrame, entries: DataFrame, state: list[ProviderState], limit: int | None = None, arrival: str = "client_id"
) -> DataFrame:
    """One row per (profile, provider): candidates found and returned, and whether an earlier profile asked the same.

    A lookup is keyed by (provider, name, version). Within a batch the versions are fixed, so the first profile of a
    name by ``arrival`` is the miss and later ones are hits. A degraded answer is never reused.
    """
    first = profiles.groupBy("canonical_name").agg(F.min(arrival).alias("_first"))
    lettered = blocking.with_letters(profiles.join(first.hint("merge"), "canonical_name"))
    totals = blocking.candidate_totals(lettered, available(entries, state))
    asked = lettered.withColumn("p", F.explode(_providers(state))).select("*", "p.*").drop("p")
    found = F.coalesce("total", F.lit(0).cast("bigint"))
    return (
        asked.join(totals, ["letters", "provider_id"], "left")
        .withColumn("total", found)
        .withColumn("returned", found if limit is None else F.least(found, F.lit(limit).cast("bigint")))
        .withColumn("cache_hit", (F.col(arrival) > F.col("_first")) & ~F.col("degraded"))
        .withColumn("name_hash", fields.name_hash(F.col("canonical_name")))
        .drop("_first", "letters")
    )


def matches(
    profiles: DataFrame,
    entries: DataFrame,
    state: list[ProviderState],
    limit: int | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Match rows for profiles with screening_id, canonical_name and dob_iso.

    ``limit`` 50 gives what the page-wise lookup sees; None finds every match on the lists. ``names`` takes the rows of
    :func:`entry_names` where they are stored with the list version.
    """
    served = available(entries, state)
    # List entries are few bytes in a file and many in memory: merge joins, not broadcasts.
    asked = served.select("entry_id").hint("merge")
    scoreable = entry_names(served) if names is None else names.join(asked, "entry_id", "left_semi")
    slim = profiles.select("screening_id", "client_id", "canonical_name", "dob_iso")
    if limit is None:
        found = simjoin.all_matches(slim, scoreable)
    else:
        lettered = blocking.with_letters(slim)
        dated = served.select("entry_id", F.col("dob_iso").alias("entry_dob"))
        pages = blocking.candidate_pages(lettered, served, limit).join(dated.hint("merge"), "entry_id")
        found = simjoin.page_matches(lettered, scoreable, pages)
    risk = served.select(
        "entry_id",
        "provider_id",
        "list_type",
        F.col("risk_payload.pep_tier").alias("pep_tier"),
        F.col("risk_payload.media_confidence").alias("media_confidence"),
    )
    return found.join(risk.hint("merge"), "entry_id").select(
        fields.stable_id("mat", F.col("screening_id"), F.col("entry_id")).alias("match_id"),
        "screening_id",
        "client_id",
        "provider_id",
        "list_type",
        "matched_name",
        F.col("score"),
        "dob_match",
        F.col("entry_id").alias("evidence_ref"),
        "pep_tier",
        "media_confidence",
    )


def with_screening_id(profiles: DataFrame, *message: str) -> DataFrame:
    """A new message makes a new screening; the same message makes the same one."""
    return profiles.withColumn("screening_id", fields.stable_id("scr", *[F.col(c) for c in message]))


def summarize(
    profiles: DataFrame, lookup: DataFrame, match: DataFrame, state: list[ProviderState], screened_at: Column
) -> DataFrame:
    """One screening row per profile, with or without matches."""
    per_lookup = lookup.groupBy("screening_id").agg(
        F.sum("returned").alias("candidates"), F.sum(F.col("cache_hit").cast("int")).cast("int").alias("cache_hits")
    )
    return screening_rows(profiles.join(per_lookup.hint("merge"), "screening_id", "left"), match, list_versions(state), state, screened_at)


def screening_rows(
    profiles: DataFrame, match: DataFrame, versions: Column, state: list[ProviderState], screened_at: Column
) -> DataFrame:
    """Screening rows of profiles that carry their candidates and cache_hits."""
    per_match = match.groupBy("screening_id").agg(
        F.count(F.lit(1)).alias("matches"), F.max("score").alias("max_score")
    )
    degraded = [s.provider_id for s in state if s.degraded]
    return profiles.join(per_match.hint("merge"), "screening_id", "left").select(
        "screening_id",
        "client_id",
        "trace_id",
        "profile_hash",
        versions.alias("list_versions"),
        F.lit("completed").alias("status"),
        F.lit(len(state)).alias("providers_queried"),
        F.coalesce("candidates", F.lit(0).cast("bigint")).alias("candidates"),
        F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
        F.coalesce("cache_hits", F.lit(0)).alias("cache_hits"),
        F.array(*[F.lit(p) for p in degraded]).cast("array<string>").alias("degraded_providers"),
        screened_at.alias("screened_at"),
    )


def screen(
    profiles: DataFrame,
    entries: DataFrame,
    state: list[ProviderState],
    limit: int | None = None,
    arrival: str = "client_id",
    screened_at: Column | None = None,
    names: DataFrame | None = None,
) -> Screened:
    """The whole screening step for profiles that carry a screening_id.

    The match table feeds the summary, the decisions and the audit. What is stored is found once a name and birth date; the
    rows of the table are that joined with the profiles, anew for each reader, as they grow with customers times entries.
    """
    lookup = lookups(profiles, entries, state, limit, arrival)
    match = matches(profiles, entries, state, limit, names)
    at = F.current_timestamp() if screened_at is None else screened_at
    return Screened(lookup, match, summarize(profiles, lookup, match, state, at))


def parity_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one result set has and the other lacks, both ways; empty when two implementations agree."""
    columns = left.columns
    return left.exceptAll(right.select(columns)).withColumn("side", F.lit("left")).unionByName(
        right.select(columns).exceptAll(left).withColumn("side", F.lit("right"))
    )
