from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_screen import entry_frame, profile_frame
from vettra.operators import decide, lists, reconcile, screen
from vettra.schemas import ENTRY

DAY = dt.date(1976, 9, 12)
ADDED = ("wl_sanctions_9001", "world_check", "sanctions", "v2", "Gregor Volkonsky", ["Grigori Volkonsky"], "1976-09-12", "RU", ("OFAC-SDN", None, None, None))
REMOVED = ("wl_sanctions_0001", "world_check", "sanctions", "v2", "Ivan Petrov", None, None, None, None)


def update_frame(spark, rows):
    return spark.createDataFrame(
        rows, f"seq bigint, provider_id string, list_type string, change string, entry {ENTRY}, new_list_version string"
    )


@pytest.fixture(scope="module")
def base(spark):
    profiles = profile_frame(
        spark,
        [("add", "gregor volkonsky", DAY), ("rem", "ivan petrov", dt.date(1972, 3, 14)), ("bump", "theodora marchetti", dt.date(1983, 2, 19))],
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    entries = entry_frame(spark, [("wl_sanctions_0001", "sanctions", ["Ivan Petrov"], dt.date(1972, 3, 14))])
    rules = decide.rules_table(spark)
    state = lists.default_state()
    at = F.lit("2024-01-02").cast("timestamp")
    done = screen.screen(profiles, entries, state, 50, "client_id", at)
    decision = decide.decide(done.screening, done.match, rules, at)
    return dict(profiles=profiles, entries=entries, screening=done.screening.cache(), decision=decision.cache(), state=state, rules=rules, limit=50, clock=F.lit("2024-01-03").cast("timestamp"))


def run(base, spark, rows):
    return reconcile.reconcile(updates=update_frame(spark, rows), **base)


def outcomes(result):
    return {r.client_id: (r.prior_outcome, r.new_outcome, r.drift) for r in result.drift.collect()}


def test_add_flips_a_clear_client(base, spark):
    result = run(base, spark, [(1, "world_check", "sanctions", "add", ADDED, "v2")])
    assert outcomes(result)["add"] == ("CLEAR", "ESCALATE", "newly_flagged")
    r = result.runs.first()
    assert (r.clients_rescreened, r.newly_flagged, r.newly_cleared, r.old_version, r.new_version) == (3, 1, 0, "v1", "v2")
    rows = {r.client_id: r for r in result.screening.collect()}
    assert rows["add"].list_versions["world_check"] == "v2" and rows["add"].trace_id == "tadd"
    assert rows["add"].list_versions["dow_jones"] == "v1"


def test_remove_clears(base, spark):
    result = run(base, spark, [(1, "world_check", "sanctions", "remove", REMOVED, "v2")])
    assert outcomes(result)["rem"] == ("ESCALATE", "CLEAR", "newly_cleared")
    assert result.served.count() == 0
    mirror = result.mirror.first()
    assert (mirror.is_active, mirror.list_version, mirror.entity_name) == (False, "v2", "Ivan Petrov")


def test_bump_rescreens_without_flips(base, spark):
    result = run(base, spark, [(1, "world_check", "sanctions", "version_bump", None, "v2")])
    assert {v[2] for v in outcomes(result).values()} == {"unchanged"} and len(outcomes(result)) == 3
    assert result.mirror.first().list_version == "v1"


def test_same_or_older_version_affects_nobody(base, spark):
    result = run(base, spark, [(1, "world_check", "sanctions", "version_bump", None, "v1")])
    r = result.runs.first()
    assert (r.clients_rescreened, r.old_version) == (0, None)


def test_waiting_updates_are_booked_on_their_own_run(base, spark):
    rows = [
        (1, "world_check", "sanctions", "add", ADDED, "v2"),
        (2, "world_check", "sanctions", "remove", ADDED, "v3"),
        (3, "dow_jones", "pep", "version_bump", None, "v2"),
        (4, "dow_jones", "pep", "rename", None, "v9"),
    ]
    result = run(base, spark, rows)
    runs = {(r.provider_id, r.new_version): (r.clients_rescreened, r.newly_flagged, r.newly_cleared) for r in result.runs.collect()}
    assert runs == {("world_check", "v2"): (3, 1, 0), ("world_check", "v3"): (3, 0, 1), ("dow_jones", "v2"): (3, 0, 0)}
    last = {r.client_id: r.list_versions for r in result.screening.collect() if r.list_versions["dow_jones"] == "v2"}
    assert len(last) == 3 and {v["world_check"] for v in last.values()} == {"v3"}
    assert result.audit.count() == result.decision.count() == result.screening.count() == 9
    assert {(s.provider_id, s.list_version) for s in result.state} >= {("world_check", "v3"), ("dow_jones", "v2")}


def test_one_run_per_event_of_a_version(base, spark):
    rows = [(1, "world_check", "sanctions", "add", ADDED, "v2"), (2, "world_check", "sanctions", "remove", REMOVED, "v2")]
    runs = {r.clients_rescreened: (r.old_version, r.newly_flagged, r.newly_cleared) for r in run(base, spark, rows).runs.collect()}
    assert runs == {3: ("v1", 1, 1), 0: (None, 0, 0)}


def test_mirror_keeps_first_names(spark):
    entries = entry_frame(spark, [("e1", "sanctions", ["Old Name"], None)]).withColumn("is_active", F.lit(True))
    renamed = ("e1", "world_check", "sanctions", "v2", "New Name", [], None, None, None)
    rows = [(1, "world_check", "sanctions", "remove", renamed, "v2"), (2, "world_check", "sanctions", "add", renamed, "v3")]
    r = reconcile.upsert_mirror(entries, update_frame(spark, rows)).first()
    assert (r.entity_name, r.list_version, r.is_active) == ("Old Name", "v3", True)


def test_unknown_version_is_stale_and_flag_to_escalate_is_no_drift(spark):
    rows = [("CLEAR", "FLAG"), ("FLAG", "ESCALATE"), ("ESCALATE", "CLEAR"), (None, "FLAG"), ("CLEAR", "CLEAR")]
    got = spark.createDataFrame(rows, "p string, n string").select(reconcile.drift_of(F.col("p"), F.col("n")).alias("d"))
    assert [r.d for r in got.collect()] == ["newly_flagged", "unchanged", "newly_cleared", "unchanged", "unchanged"]


def test_scenario_check(spark):
    drift = spark.createDataFrame([("a", "CLEAR")], "client_id string, new_outcome string")
    expected = spark.createDataFrame([("a", "CLEAR"), ("b", "ESCALATE")], "client_id string, expected_outcome_after string")
    assert {r.client_id: r.ok for r in reconcile.scenario_check(drift, expected).collect()} == {"a": True, "b": False}
