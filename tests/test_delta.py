"""Delta re-screening gives the rows of a full one, and compares only what changed."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_reconcile import update_frame
from test_screen import entry_frame, profile_frame
from vettra.operators import decide, lists, reconcile, screen, simjoin

FIRST = ["ivan", "gregor", "anna", "maria", "peter", "olga"]
LAST = ["petrov", "volkonsky", "marchetti", "smith", "meyer"]
TYPES = [("sanctions", "world_check"), ("pep", "dow_jones"), ("adverse_media", "comply_advantage")]


def day(rng):
    return dt.date(1970 + rng.randrange(3), 5, 1 + rng.randrange(3))


def world(spark, seed, n=40):
    rng = random.Random(seed)
    name = lambda: f"{rng.choice(FIRST)} {rng.choice(LAST)}"
    people = [(f"c{i:02}", name(), day(rng) if rng.random() < 0.8 else None) for i in range(n)]
    listed = [(f"e{i:02}", rng.choice(TYPES)[0], [name(), name()][: rng.choice([1, 2])], day(rng) if rng.random() < 0.8 else None) for i in range(30)]
    updates = []
    for seq in range(14):
        kind, provider = rng.choice(TYPES)
        change, entry_id = rng.choice(["add", "add", "remove", "version_bump"]), f"e{rng.randrange(36):02}"
        entry = (entry_id, provider, kind, "v2", name(), [name()], str(day(rng)), None, ("ref", rng.choice([1, 2, None]), 0.9, None))
        updates.append((seq, provider, kind, change, None if change == "version_bump" else entry, rng.choice(["v1", "v2", "v2", "v3"] if seq < 7 else ["v2"])))
    profiles = profile_frame(spark, people).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return profiles, entry_frame(spark, listed), update_frame(spark, updates)


def rows(frame, *without):
    return sorted((r.asDict(recursive=True) for r in frame.drop(*without).collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_delta_equals_full(spark, seed):
    profiles, entries, updates = world(spark, seed)
    state, rules, at = lists.default_state(), decide.rules_table(spark), F.lit("2024-01-02").cast("timestamp")
    done = screen.screen(profiles, entries, state, None, "client_id", at)
    # Some clients were screened on an older list, or under another profile: they are screened in full.
    old = F.create_map(F.lit("world_check"), F.lit("v0"), F.lit("dow_jones"), F.lit("v1"), F.lit("comply_advantage"), F.lit("v1"))
    screening = done.screening.withColumn("list_versions", F.when(F.col("client_id") == "c03", old).otherwise(F.col("list_versions")))
    screening = screening.withColumn("profile_hash", F.when(F.col("client_id") == "c04", "other").otherwise(F.col("profile_hash"))).cache()
    decision = decide.decide(screening, done.match, rules, at).cache()
    base = dict(profiles=profiles, entries=entries, screening=screening, decision=decision, updates=updates, state=state, rules=rules, clock=F.lit("2024-01-03").cast("timestamp"))
    full, delta = reconcile.reconcile(**base), reconcile.reconcile(**base, match=done.match)
    for part in ("served", "mirror", "match", "screening", "decision", "audit", "drift", "runs"):
        assert rows(getattr(delta, part)) == rows(getattr(full, part)), part
    assert delta.state == full.state
    assert full.drift.where("drift <> 'unchanged'").count() > 0 and full.match.count() > 0


def test_only_added_entries_are_compared(spark, monkeypatch):
    profiles, entries, updates = world(spark, 4)
    state, rules = lists.default_state(), decide.rules_table(spark)
    done = screen.screen(profiles, entries, state, None, "client_id", F.lit("2024-01-02").cast("timestamp"))
    decision = decide.decide(done.screening, done.match, rules, F.lit("2024-01-02").cast("timestamp"))
    compared, real = [], simjoin.all_matches
    monkeypatch.setattr(screen.simjoin, "all_matches", lambda p, n: (compared.append(n.select("entry_id").distinct().count()), real(p, n))[1])
    reconcile.reconcile(profiles, entries, done.screening, decision, updates, state, rules, match=done.match)
    assert compared == [reconcile.entry_changes(reconcile.with_round(updates, reconcile.change_sets(updates))).where("change = 'add'").count()]


def test_rounds_of_a_client(spark):
    updates = update_frame(spark, [(1, "p", "pep", "version_bump", None, "v2"), (2, "q", "pep", "version_bump", None, "v1"), (3, "p", "pep", "version_bump", None, "v2"), (4, "p", "pep", "version_bump", None, "v3")])
    changes = reconcile.change_sets(updates)
    states = reconcile.states_after(changes, [lists.ProviderState("pep", "p"), lists.ProviderState("pep", "q")])
    versions = spark.createDataFrame([("a", {"p": "v1", "q": "v1"}), ("b", {"p": "v2", "q": "v0"}), ("c", {})], "client_id string, list_versions map<string,string>")
    got = sorted(tuple(r) for r in reconcile.affected_rounds(versions, changes, states).collect())
    assert got == [("a", 0, "v1"), ("a", 2, "v2"), ("b", 1, "v0"), ("b", 2, "v2"), ("c", 0, None), ("c", 2, "v2")]


def test_the_last_round_leaves_the_latest_screening_and_outcome(spark):
    """Rounds of one batch have no time of their own: a later batch must not take an earlier round for the latest."""
    profiles, entries, _ = world(spark, 4)
    updates = update_frame(spark, [(i, p, kind, "version_bump", None, "v2") for i, (kind, p) in enumerate(TYPES)])
    state, rules, at = lists.default_state(), decide.rules_table(spark), F.lit("2024-01-02").cast("timestamp")
    done = screen.screen(profiles, entries, state, None, "client_id", at)
    decision = decide.decide(done.screening, done.match, rules, at)
    after = reconcile.reconcile(profiles, entries, done.screening, decision, updates, state, rules, match=done.match)
    used = reconcile.used_versions(after.screening).collect()
    assert len(used) == 40 and all(set(r.list_versions.values()) == {"v2"} for r in used)
    times = after.decision.groupBy("client_id").agg(F.count_distinct("decided_at").alias("n"))
    assert times.where("n <> 3").count() == 0
