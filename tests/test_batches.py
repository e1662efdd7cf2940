"""A batch of several tables is seen whole or not at all, whichever write broke off; lists outlive batches."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from vettra import schemas
from vettra.operators import lists
from vettra.plans import queries_quality as qq
from vettra.plans.pipeline import run_for
from vettra.streaming import jobs

SF = "/root/testdata/sf0.001"


class Broken(RuntimeError):
    pass


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-vettra-test-", dir="/tmp")


@pytest.mark.parametrize("broken_at", [1, 3, 4])
def test_a_broken_batch_leaves_nothing_visible(spark, folder, monkeypatch, broken_at):
    run, written = run_for(spark, SF), []
    work = jobs.Jobs(spark, folder, lambda: (run.entries, lists.default_state()))
    sent = qq.submission_messages(spark, SF)
    real = jobs.tables.write_batch

    def broken(rows, root, table, batch_id):
        real(rows, root, table, batch_id)
        written.append(table)
        if len(written) == broken_at:
            raise Broken

    with monkeypatch.context() as patch:
        patch.setattr(jobs.tables, "write_batch", broken)
        with pytest.raises(Broken):
            work.normalize_batch(sent, 0)
    shapes = {"normalized_profile": schemas.NORMALIZED_PROFILE, "dead_letter": schemas.DEAD_LETTER, "stage_log_normalize": schemas.STAGE_LOG}
    assert all(work.table(name, shape).count() == 0 for name, shape in shapes.items())
    work.normalize_batch(sent, 0)
    work.normalize_batch(sent.limit(0), 0)  # published: not worked on again
    assert work.table("normalized_profile", schemas.NORMALIZED_PROFILE).count() == 150
    assert work.table("dead_letter", schemas.DEAD_LETTER).count() > 0


def test_removed_and_added_again(spark, folder):
    """Two batches: clients clear and escalate again, names stay, and the second batch carries stored matches over."""
    work, run = qq.stored_run(spark, SF, folder), run_for(spark, SF)
    target = run.match.where("list_type = 'sanctions' AND score >= 0.95").select("evidence_ref", "client_id").first()
    entry = run.entries.where(F.col("entry_id") == target.evidence_ref).drop("j").first().asDict(recursive=True)
    changes = [("remove", entry, "v2"), ("add", {**entry, "entity_name": entry["entity_name"] + "a"}, "v3")]
    for i, (change, told, version) in enumerate(changes):
        payload = {"provider_id": "world_check", "list_type": "sanctions", "change": change, "entry": told, "new_list_version": version}
        value = json.dumps({"trace_id": f"t{i}", "client_id": "world_check", "event_type": "watchlist.updated", "payload": json.dumps(payload, default=str)})
        rows = spark.createDataFrame([("watchlist.updated", 0, i, "world_check", value, None)], schemas.MESSAGE)
        work.reconcile_batch(rows, i)
        mirror = spark.read.parquet(f"{folder}/list_mirror/batch_id={i}").where(F.col("entry_id") == target.evidence_ref).first()
        assert (mirror.entity_name, mirror.list_version, mirror.is_active) == (entry["entity_name"], version, i == 1)
        served = work.lists_now()[0].where(F.col("entry_id") == target.evidence_ref).collect()
        assert [r.entity_name for r in served] == ([entry["entity_name"] + "a"] if i else [])
    again = work.table("decision_rescreened", schemas.DECISION).where(F.col("client_id") == target.client_id)
    assert [r.outcome for r in again.orderBy("batch_id").collect()][0] != "ESCALATE"
    assert work.table("reconciliation_run", schemas.RECONCILIATION_RUN).count() == 2
    # The same rows as screening everybody on the list as it is now.
    full = jobs.screen.matches(run.profiles, work.lists_now()[0], lists.default_state()).select("client_id", "evidence_ref", "score")
    last = work.table("match_rescreened", jobs.MATCH_AGAIN).where("batch_id = 1").select("client_id", "evidence_ref", F.round("score", 4).alias("score"))
    assert full.exceptAll(last).count() == last.exceptAll(full).count() == 0
