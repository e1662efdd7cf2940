"""List changes: new list state, who is affected, re-screening, and the drift it causes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from vettra.constants import LIST_CHANGES
from vettra.functions.fields import stable_id, version_key
from vettra.operators import blocking
from vettra.operators import decide as rules_engine
from vettra.operators import screen as screening_step
from vettra.operators.dedup import last_of
from vettra.operators.lists import ProviderState
from vettra.session import stored


MATCH_FACTS = ["provider_id", "list_type", "matched_name", "score", "dob_match", "evidence_ref", "pep_tier", "media_confidence"]
ROUND_FACTS = ["provider_id", "list_type", "new_list_version", "seq"]


@dataclass(frozen=True)
class Reconciled:
    served: DataFrame
    state: list[ProviderState]
    mirror: DataFrame
    match: DataFrame
    screening: DataFrame
    decision: DataFrame
    audit: DataFrame
    drift: DataFrame
    runs: DataFrame


def known_changes(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split updates into known kinds of change and the rest, which is refused."""
    known = F.coalesce(F.col("change").isin(LIST_CHANGES), F.lit(False))
    return updates.where(known), updates.where(~known)


def served_list(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """The list after the updates: the latest change of an entry decides; a removed entry is gone.

    An entry added twice is served once. Entries keep their columns.
    """
    columns = entries.columns
    latest = last_of(
        updates.where(F.col("change").isin("add", "remove")).select(
            F.col("entry.entry_id").alias("entry_id"), "change", "entry", "seq"
        ),
        ["entry_id"],
        "seq",
    )
    kept = entries.join(latest.select("entry_id"), "entry_id", "left_anti").select(columns)
    added = latest.where("change = 'add'").select("entry.*")
    for name in columns:
        if name not in added.columns:
            added = added.withColumn(name, F.lit(None).cast(entries.schema[name].dataType))
    return kept.unionByName(added.select(columns))


def upsert_mirror(mirror: DataFrame, updates: DataFrame) -> DataFrame:
    """The local copy of the lists: new entries come in, known ones change version and activity but keep their names.

    ``mirror`` has the entry columns plus ``is_active``. Names come from the first row seen of an entry, version and
    activity from the last; a version bump touches nothing.
    """
    columns = [c for c in mirror.columns if c not in ("list_version", "is_active")]
    changed = updates.where(F.col("change").isin("add", "remove")).select(
        "entry.*", F.col("new_list_version").alias("_version"), (F.col("change") != "remove").alias("_active"), "seq"
    )
    for name in columns:
        if name not in changed.columns:
            changed = changed.withColumn(name, F.lit(None).cast(mirror.schema[name].dataType))
    both = mirror.select(
        *columns, F.col("list_version").alias("_version"), F.col("is_active").alias("_active"), F.lit(-1).cast("bigint").alias("seq")
    ).unionByName(changed.select(*columns, "_version", "_active", F.col("seq").cast("bigint").alias("seq")))
    rest = [c for c in columns if c != "entry_id"]
    merged = both.groupBy("entry_id").agg(
        F.min_by(F.struct(*rest), "seq").alias("first"), F.max_by(F.struct("_version", "_active"), "seq").alias("last")
    )
    return merged.select(
        "entry_id", "first.*", F.col("last._version").alias("list_version"), F.col("last._active").alias("is_active")
    ).select(mirror.columns)


def latest_screening(screening: DataFrame) -> DataFrame:
    """Each client's most recent screening; the id breaks a tie."""
    return last_of(screening, ["client_id"], "screened_at", "screening_id")


def latest_outcome(decision: DataFrame) -> DataFrame:
    """Each client's most recent outcome."""
    return decision.groupBy("client_id").agg(
        F.max_by("outcome", F.struct("decided_at", "decision_id")).alias("outcome")
    )


def latest_profile(profiles: DataFrame) -> DataFrame:
    return last_of(profiles, ["client_id"], "created_at", "profile_hash")


def change_sets(updates: DataFrame) -> list[Row]:
    """(provider_id, list_type, new_list_version, seq) of each version a provider published, in order of arrival.

    One row per provider and version: a batch has as many rounds as there are versions in it, however many changes and
    clients.
    """
    keys = ["provider_id", "list_type", "new_list_version"]
    return sorted(updates.groupBy(*keys).agg(F.min("seq").alias("seq")).collect(), key=lambda r: r.seq)


def used_versions(screening: DataFrame) -> DataFrame:
    """(client_id, list_versions) of each client's latest screening."""
    rows = screening.select("client_id", "screened_at", "screening_id", "list_versions")
    return latest_screening(rows).select("client_id", "list_versions")


def affected_clients(versions: DataFrame, provider_id: str, new_version: str) -> DataFrame:
    """(client_id, old_version): clients whose latest screening used an older version of the provider's list."""
    old = F.col("list_versions")[provider_id]
    return versions.where(version_key(old) < version_key(F.lit(new_version))).select("client_id", old.alias("old_version"))


def drift_of(prior: Column, new: Column) -> Column:
    """From CLEAR to a risk outcome, back, or neither; FLAG to ESCALATE and no prior outcome count as unchanged."""
    return (
        F.when((prior == "CLEAR") & new.isin("FLAG", "ESCALATE"), "newly_flagged")
        .when(prior.isin("FLAG", "ESCALATE") & (new == "CLEAR"), "newly_cleared")
        .otherwise("unchanged")
    )


def run_id() -> Column:
    """One run per update event: its provider, version and place in the order of arrival."""
    return stable_id("run", F.col("provider_id"), F.col("new_list_version"), F.col("seq").cast("string"))


def run_rows(updates: DataFrame, drift: DataFrame, started: Column, finished: Column) -> DataFrame:
    """One reconciliation run per update event, also where nobody was affected.

    The first event of a version finds the clients it outdates; later events of that version find them up to date.
    """
    counted = drift.groupBy("run_id").agg(
        # The last affected client in client order names the old version.
        F.max_by("old_version", "client_id").alias("old_version"),
        F.count(F.lit(1)).cast("int").alias("clients_rescreened"),
        F.count_if(F.col("drift") == "newly_flagged").cast("int").alias("newly_flagged"),
        F.count_if(F.col("drift") == "newly_cleared").cast("int").alias("newly_cleared"),
    )
    rows = updates.withColumn("run_id", run_id()).join(counted, "run_id", "left")
    carried = [c for c in ("message_key",) if c in updates.columns]
    return rows.select(
        F.col("run_id").alias("id"),
        "provider_id",
        "list_type",
        "old_version",
        F.col("new_list_version").alias("new_version"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("clients_rescreened", "newly_flagged", "newly_cleared")],
        started.alias("started_at"),
        finished.alias("finished_at"),
        *carried,
    )


def states_after(changes: list[Row], state: list[ProviderState]) -> list[list[ProviderState]]:
    """What the providers serve after each change set."""
    out = []
    for change in changes:
        state = [
            replace(s, list_version=change.new_list_version) if s.provider_id == change.provider_id else s for s in state
        ]
        out.append(state)
    return out


def _number(version: str | None) -> int:
    digits = (version or "").lstrip("vV").strip()
    return int(digits) if digits.isascii() and digits.lstrip("+-").isdigit() and len(digits) < 18 else 0


def is_silent(changes: list[Row], state: list[ProviderState]) -> bool:
    """Whether a change set has a version that outdates nobody who is up to date.

    Then the list may differ from what up-to-date clients were screened against, and their stored matches do not tell.
    """
    newest = {s.provider_id: _number(s.list_version) for s in state}
    for change in changes:
        if _number(change.new_list_version) <= newest.get(change.provider_id, 0):
            return True
        newest[change.provider_id] = _number(change.new_list_version)
    return False


def with_round(updates: DataFrame, changes: list[Row]) -> DataFrame:
    """Each update's round: the place of its change set in the order of arrival."""
    same = [
        (F.col("provider_id").eqNullSafe(F.lit(c.provider_id)) & F.col("list_type").eqNullSafe(F.lit(c.list_type)))
        & F.col("new_list_version").eqNullSafe(F.lit(c.new_list_version))
        for c in changes
    ]
    return updates.withColumn("round", F.coalesce(*[F.when(ok, F.lit(i)) for i, ok in enumerate(same)]))


def entry_changes(updates: DataFrame) -> DataFrame:
    """(entry_id, round, change, entry, until): what each round leaves of an entry it touches, and the round that touches
    the entry next. Within a round the latest change decides."""
    touched = updates.where(F.col("change").isin("add", "remove"))
    latest = last_of(
        touched.select(F.col("entry.entry_id").alias("entry_id"), "round", "change", "entry", "seq"), ["entry_id", "round"], "seq"
    )
    return latest.withColumn("until", F.lead("round").over(Window.partitionBy("entry_id").orderBy("round"))).drop("seq")


def as_entries(changed: DataFrame, like: DataFrame) -> DataFrame:
    """The added entries of ``changed`` with the columns of ``like``, and ``round`` and ``until``."""
    added = changed.where("change = 'add'").select("entry.*", "round", "until")
    for name in like.columns:
        if name not in added.columns:
            added = added.withColumn(name, F.lit(None).cast(like.schema[name].dataType))
    return added.select(*like.columns, "round", "until")


def served_after(entries: DataFrame, changes: DataFrame, at_round: int) -> DataFrame:
    """The list after a round, from the list before the first and the changes of :func:`entry_changes`."""
    touched = changes.where(F.col("round") <= at_round)
    added = as_entries(touched.where(F.col("until").isNull() | (F.col("until") > at_round)), entries)
    kept = entries.join(touched.select("entry_id").distinct(), "entry_id", "left_anti").select(entries.columns)
    return kept.unionByName(added.drop("round", "until"))


def affected_rounds(versions: DataFrame, changes: list[Row], states: list[list[ProviderState]]) -> DataFrame:
    """(client_id, round, old_version): the rounds that outdate a client, who is up to date again after each.

    ``versions`` has the ``list_versions`` of each client's latest screening.
    """
    after = F.array(*[screening_step.list_versions(s) for s in states])
    rounds = F.array(
        *[F.struct(F.lit(i).alias("round"), F.lit(c.provider_id).alias("of"), F.lit(c.new_list_version).cast("string").alias("version")) for i, c in enumerate(changes)]
    )
    none = F.array().cast("array<struct<round:int,old_version:string>>")
    start = F.struct(F.lit(-1).alias("last"), none.alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        used = F.when(acc["last"] < 0, F.try_element_at(F.col("list_versions"), x["of"])).otherwise(
            F.try_element_at(F.get(after, acc["last"]), x["of"])
        )
        hit = version_key(used) < version_key(x["version"])
        more = F.concat(acc["hits"], F.array(F.struct(x["round"].alias("round"), used.alias("old_version"))))
        return F.struct(
            F.when(hit, x["round"]).otherwise(acc["last"]).alias("last"), F.when(hit, more).otherwise(acc["hits"]).alias("hits")
        )

    hits = F.aggregate(rounds, start, step)["hits"]
    return versions.select("client_id", F.explode(hits).alias("x")).select("client_id", "x.round", "x.old_version")


def carried_matches(asked: DataFrame, match: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored matches of up-to-date clients that are still matches in a round: their entry is untouched until then."""
    gone = changes.groupBy("entry_id").agg(F.min("round").alias("gone")).withColumnRenamed("entry_id", "evidence_ref")
    old = match.select("screening_id", *[c for c in MATCH_FACTS]).withColumnRenamed("screening_id", "prior_screening_id")
    rows = asked.where("current").select("prior_screening_id", "screening_id", "client_id", "round").join(old, "prior_screening_id")
    rows = rows.join(gone, "evidence_ref", "left").where("gone IS NULL OR round < gone")
    return rows.select("screening_id", "client_id", *MATCH_FACTS)


def added_matches(asked: DataFrame, entries: DataFrame, changes: DataFrame, state: list[ProviderState]) -> DataFrame:
    """Matches of up-to-date clients with added entries, in the rounds in which those are on the list.

    Every version of an entry is compared once with every person, however many rounds there are.
    """
    added = as_entries(changes, entries).withColumn("entry_id", F.concat_ws("#", "round", "entry_id"))
    life = added.select(F.col("entry_id").alias("evidence_ref"), F.col("round").alias("since"), "until")
    people = asked.where("current").select(F.col("client_id").alias("screening_id"), "client_id", "canonical_name", "dob_iso")
    found = screening_step.matches(people.distinct(), added.drop("round", "until"), state).drop("match_id", "screening_id")
    rows = asked.where("current").select("screening_id", "client_id", "round").join(found.join(life, "evidence_ref"), "client_id")
    rows = rows.where("since <= round AND (until IS NULL OR round < until)")
    true_id = F.substring(F.col("evidence_ref"), F.length(F.substring_index("evidence_ref", "#", 1)) + 2, F.length("evidence_ref"))
    return rows.withColumn("evidence_ref", true_id).select("screening_id", "client_id", *MATCH_FACTS)


def candidate_changes(asked: DataFrame, entries: DataFrame, changes: DataFrame) -> DataFrame:
    """(letters, round, change): by how much a round's candidates differ from those before the first."""
    added = as_entries(changes, entries).withColumn("sign", F.lit(1))
    gone = changes.groupBy("entry_id").agg(F.min("round").alias("round"))
    left = entries.join(gone, "entry_id").withColumns({"until": F.lit(None).cast("int"), "sign": F.lit(-1)})
    steps = added.unionByName(left.select(added.columns))
    # The count is by provider; here each step of the list stands for one.
    steps = steps.withColumn("provider_id", F.concat_ws(":", "sign", "round", F.coalesce(F.col("until").cast("string"), F.lit(""))))
    totals = blocking.candidate_totals(asked.select("letters").distinct(), steps).withColumn("s", F.split("provider_id", ":"))
    facts = totals.select(
        "letters", (F.col("s")[0].cast("int") * F.col("total")).alias("change"), F.col("s")[1].cast("int").alias("since"),
        F.col("s")[2].try_cast("int").alias("until"),
    )
    rounds = asked.select("letters", "round").distinct().join(facts, "letters")
    rounds = rounds.where("since <= round AND (until IS NULL OR round < until)")
    return rounds.groupBy("letters", "round").agg(F.sum("change").alias("change"))


def reconcile(
    profiles: DataFrame,
    entries: DataFrame,
    screening: DataFrame,
    decision: DataFrame,
    updates: DataFrame,
    state: list[ProviderState],
    rules: DataFrame,
    limit: int | None = None,
    clock: Column | None = None,
    match: DataFrame | None = None,
    mirror: DataFrame | None = None,
) -> Reconciled:
    """Apply the updates and screen the clients each new version outdates again, with their original trace.

    ``updates`` carries ``seq``, its order of arrival. Versions are rounds, worked off in that order: each changes its own
    provider's list, and what it does to outcomes is booked on its own run. A client that two providers' versions
    outdate is screened twice, as its outcome may change twice. Every screening leads to a decision and an audit row.

    All rounds are one pass. ``match`` holds the stored matches of the screenings: for a client whose latest screening used
    what ``state`` and ``entries`` hold now, only entries that a round adds are compared with the name; matches with
    entries that a round removes go, the others are carried over. Other clients, and all of them without ``match`` or with
    a page ``limit``, are screened against the whole list of each round. ``mirror`` is the local copy kept from earlier
    batches.
    """
    now = F.current_timestamp() if clock is None else clock
    updates = stored(known_changes(updates)[0], "update")
    changes = change_sets(updates)
    if not changes:
        raise ValueError("no known update")
    states = states_after(changes, state)
    touched = stored(entry_changes(with_round(updates, changes)), "entry-changes")
    kept = entries.withColumn("is_active", F.lit(True)) if mirror is None else mirror
    mirror = upsert_mirror(kept, updates)
    people = latest_profile(
        profiles.select("client_id", "trace_id", "profile_hash", "canonical_name", "dob_iso", "created_at")
    )

    facts = ["client_id", "screened_at", "screening_id", "list_versions"]
    exact = limit is None and match is not None and not any(s.degraded for s in state)
    latest = latest_screening(screening.select(*facts, *(["profile_hash", "degraded_providers", "candidates"] if exact else [])))
    if exact:
        current = F.size("degraded_providers") == 0
        for s in state:
            current &= F.try_element_at("list_versions", F.lit(s.provider_id)).eqNullSafe(F.lit(s.list_version))
        latest = latest.withColumns({"current": F.coalesce(current, F.lit(False)), "prior_hash": F.col("profile_hash")})
        latest = latest.drop("profile_hash")
    else:
        latest = latest.withColumns({"current": F.lit(False), "prior_hash": F.lit(""), "candidates": F.lit(0).cast("bigint")})
    # Clients without a normalized profile are skipped: the inner join drops them.
    told = F.get(F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ROUND_FACTS]) for c in changes]), F.col("round"))
    asked = (
        affected_rounds(latest, changes, states)
        .join(latest.withColumnsRenamed({"screening_id": "prior_screening_id", "candidates": "prior_candidates"}).drop("list_versions"), "client_id")
        .join(people, "client_id")
        .withColumn("current", F.col("current") & (F.col("prior_hash") == F.col("profile_hash")))
        .withColumn("f", told)
        .select("*", "f.*")
        .withColumn("run_id", run_id())
        .withColumn("screening_id", stable_id("scr", F.col("run_id"), F.col("client_id")))
        .withColumn(
            "rescreen_reason", F.concat_ws(" ", F.lit("list_update"), F.col("provider_id"), F.col("new_list_version"))
        )
        .drop("f", "prior_hash", "screened_at")
    )
    asked = stored(blocking.with_letters(asked), "rescreen")

    parts, counts = [], []
    if exact:
        parts += [carried_matches(asked, match, touched), added_matches(asked, entries, touched, state)]
        moved = candidate_changes(asked.where("current"), entries, touched)
        counts.append(
            asked.where("current").join(moved, ["letters", "round"], "left").select(
                "screening_id", (F.col("prior_candidates") + F.coalesce("change", F.lit(0))).alias("candidates")
            )
        )
    if not exact or not asked.where("NOT current").isEmpty():
        for i, after in enumerate(states):
            own, list_now = asked.where(F.col("round") == i).where("NOT current"), served_after(entries, touched, i)
            parts.append(screening_step.matches(own, list_now, after, limit).select("screening_id", "client_id", *MATCH_FACTS))
            looked = screening_step.lookups(own.drop("provider_id", "list_type", "letters"), list_now, after, limit)
            counts.append(looked.groupBy("screening_id").agg(F.sum("returned").alias("candidates")))
    found = reduce(DataFrame.unionByName, [p.withColumn("score", F.col("score").cast("double")) for p in parts])
    found = found.select(stable_id("mat", F.col("screening_id"), F.col("evidence_ref")).alias("match_id"), "*").select(
        "match_id", "screening_id", "client_id", *MATCH_FACTS
    )
    found = stored(found, "rescreen_match")

    first = asked.groupBy("round", "canonical_name").agg(F.min("client_id").alias("first_client"))
    reused = (F.col("client_id") > F.col("first_client")).cast("int") * sum(not s.degraded for s in state)
    rows = asked.join(first, ["round", "canonical_name"]).withColumn("cache_hits", reused)
    rows = rows.join(reduce(DataFrame.unionByName, counts), "screening_id", "left")
    versions = F.get(F.array(*[screening_step.list_versions(s) for s in states]), F.col("round"))
    # Rounds follow each other, so the last one leaves a client's latest screening and outcome: a microsecond a round.
    at_round = F.timestamp_micros(F.unix_micros(now) + F.col("round"))
    screened = stored(screening_step.screening_rows(rows, found, versions, state, at_round), "rescreen_screening")
    decided = stored(rules_engine.decide(screened, found, rules, F.col("screened_at")), "rescreen_decision")

    outcomes = latest_outcome(decision).withColumnRenamed("outcome", "initial")
    new = decided.select("screening_id", F.col("outcome").alias("new_outcome"))
    drift = asked.select("round", *ROUND_FACTS, "run_id", "client_id", "screening_id", "old_version", "rescreen_reason").join(new, "screening_id")
    order = Window.partitionBy("client_id").orderBy("round")
    drift = drift.withColumns({"place": F.row_number().over(order), "before": F.lag("new_outcome").over(order)})
    drift = drift.join(outcomes, "client_id", "left").withColumn(
        "prior_outcome", F.when(F.col("place") == 1, F.col("initial")).otherwise(F.col("before"))
    )
    drift = stored(drift.withColumn("drift", drift_of(F.col("prior_outcome"), F.col("new_outcome"))).drop("round", "place", "before", "initial"), "drift")
    return Reconciled(
        served=served_after(entries, touched, len(changes) - 1),
        state=states[-1],
        mirror=mirror,
        match=found,
        screening=screened,
        decision=decided,
        audit=rules_engine.audit(screened, found, decided, rules),
        drift=drift,
        runs=run_rows(updates, drift, now, now),
    )


def scenario_check(drift: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare outcomes after an update with (client_id, expected_outcome_after)."""
    return expected.join(drift.select("client_id", "new_outcome"), "client_id", "left").withColumn(
        "ok", F.coalesce(F.col("new_outcome") == F.col("expected_outcome_after"), F.lit(False))
    )
