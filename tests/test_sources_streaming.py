from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vettra import schemas
from vettra.operators import lists, seen
from vettra.plans import queries_quality
from vettra.plans.pipeline import run_for
from vettra.sources import events, files, tables
from vettra.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-vettra-test-", dir="/tmp"))


def test_watchlist_files(spark, folder):
    row = {"entry_id": "wl_pep_0001", "provider_id": "dow_jones", "list_type": "pep", "entity_name": "A B", "aliases": ["C"], "extra": 1}
    (folder / "pep.jsonl").write_text(json.dumps(row) + "\n\n  \n" + json.dumps({**row, "entry_id": "wl_pep_0002"}) + "\n")
    assert files.read_watchlists(spark, str(folder)).count() == 2
    assert sorted(r.locator for r in files.missing_files(spark, str(folder)).collect()) == ["adverse_media.jsonl", "sanctions.jsonl"]
    assert files.read_golden(spark, str(folder / "none.jsonl"), "decisions").count() == 0


def test_manifest_updates_and_submissions(spark, folder):
    manifest = {"seed": 42, "list_version": "v1", "providers": {"dow_jones": {"list_type": "pep", "count": 2, "file": "pep.jsonl"}}, "plant_targets": ["a", "b"]}
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=2))
    declared, targets = files.read_manifest(spark, str(folder / "manifest.json"))
    assert (declared.first()["count"], targets.count()) == (2, 2)
    update = {"provider_id": "world_check", "change": "add", "entry": {"entry_id": "e"}, "new_list_version": "v2", "target_profile": {"full_name": "G"}}
    (folder / "u.jsonl").write_text(json.dumps(update) + "\n")
    assert files.read_updates(spark, str(folder / "u.jsonl")).select("entry.entry_id", "target_profile.full_name").first() == ("e", "G")
    (folder / "kyc.jsonl").write_text(json.dumps({"full_name": "A", "_meta": {"category": "dirty"}, "junk": 1}) + "\n")
    assert files.read_submissions(spark, str(folder / "kyc.jsonl")).first()._meta.category == "dirty"


def test_fingerprints_ignore_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "x int, y string")
    assert files.fingerprint(rows).first() == files.fingerprint(rows.orderBy(F.desc("x")).repartition(3)).first()
    assert files.exact_digest(rows).first() == files.exact_digest(rows.repartition(3)).first()
    assert files.fingerprint(rows).first() != files.fingerprint(rows.where("x < 3")).first()


def test_envelopes(spark):
    rows = spark.createDataFrame([("t", "c", "x")], "trace_id string, client_id string, v string")
    sent = events.to_messages(rows, events.envelope("e", "p", F.struct("v"))).withColumns(
        {"topic": F.lit("topic"), "partition": F.lit(1), "offset": F.lit(2).cast("bigint"), "timestamp": F.current_timestamp()}
    )
    good = events.parse(sent).first()
    assert (good.error, good.message_key, good.e.schema_version, json.loads(good.e.payload)) == (None, "t:topic:1:2", 1, {"v": "x"})
    for value, error in (("{", "invalid_json"), (None, "invalid_json"), ('{"trace_id":"t"}', "missing_field")):
        bad = events.parse(sent.withColumn("value", F.lit(value).cast("string")))
        assert bad.first().error == error
        letter = events.dead_letters(bad, "normalize").first()
        assert (letter.error_type, letter.offset, letter.payload) == (error, 2, value)


def test_tables_overwrite_a_replayed_batch(spark, folder):
    rows = spark.createDataFrame([("k", None)], schemas.IDEMPOTENCY)
    assert tables.read_table(spark, str(folder), "idem", schemas.IDEMPOTENCY).count() == 0
    for _ in range(2):
        tables.write_batch(rows, str(folder), "idem", 0)
    tables.write_batch(rows, str(folder), "idem", 1)
    assert tables.read_table(spark, str(folder), "idem", schemas.IDEMPOTENCY).count() == 2
    assert tables.read_table(spark, str(folder), "idem", schemas.IDEMPOTENCY, 1).count() == 1
    read = lambda: tables.read_table(spark, str(folder), "idem", schemas.IDEMPOTENCY, job="j")
    assert read().count() == 0
    tables.publish(spark, str(folder), "j", 1, ["idem", "other"])
    assert [r.batch_id for r in read().collect()] == [1] and tables.is_published(spark, str(folder), "j", 1)


def test_key_index(spark, folder):
    """What passes the index covers what is stored, with few false alarms; only such folders are opened."""
    root, n = str(folder), 4_000
    for batch in range(6):
        rows = spark.range(batch * n, batch * n + (0 if batch == 5 else n)).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("owner"))
        tables.write_batch(rows, root, "t", batch)
        tables.write_index(rows, root, "t", ["key"], batch)
        tables.write_index(rows, root, "t", ["key", "owner"], batch)
    asked = spark.createDataFrame([(str(i), "x") for i in (5, n - 1, 3 * n)], "key string, owner string")
    for keys in (["key"], ["key", "owner"]):
        opened = tables.batches_to_open(asked, root, "t", keys)
        assert {0, 3} <= set(opened) and len(opened) <= 3
    assert tables.batches_to_open(asked.limit(0), root, "t", ["key"]) == tables.batches_to_open(asked, root, "none", ["key"]) == []
    strange = spark.range(10**6, 10**6 + 500).select(F.col("id").cast("string").alias("key"))
    one = tables._read(spark, f"{root}/key_index/t.key", seen.INDEX)
    told = strange.collect()
    alarms = sum(seen.batches_with(strange.where(F.col("key") == r.key), ["key"], one).count() for r in told[:20])
    assert alarms <= 3
    history = tables.read_table(spark, root, "t", "key string").where(F.col("batch_id").isin(tables.batches_to_open(asked, root, "t", ["key"])))
    assert history.join(asked, "key", "left_semi").count() == 3
    files_read = [f for f in history._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in f]
    assert "batch_id" in files_read[0]


def test_streams_end_to_end(spark, folder):
    root, run = str(folder), run_for(spark, SF)
    sent = queries_quality.submission_messages(spark, SF)
    sent.where("offset % 2 = 0").write.parquet(f"{root}/in/first")
    lists_now = {"entries": run.entries, "state": lists.default_state()}
    work = jobs.Jobs(spark, root, lambda: (lists_now["entries"], lists_now["state"]), 50)

    def step():
        source = events.read_topic_files(spark, f"{root}/in/*")
        jobs.run_once(work.start_normalize(source, once=True))
        jobs.run_once(work.start_screen(once=True))
        jobs.run_once(work.start_decide(once=True))

    step()
    sent.write.parquet(f"{root}/in/second")  # everything again: half of it was delivered before
    step()
    profiles = work.table("normalized_profile", schemas.NORMALIZED_PROFILE)
    decided = work.table("decision", schemas.DECISION)
    assert profiles.count() == 150 and profiles.select("message_key").distinct().count() == 150
    assert decided.count() == 150 and work.table("audit", schemas.AUDIT).count() == 150
    batch = run.decision.select("client_id", "outcome", "reason_codes")
    assert batch.exceptAll(decided.select("client_id", "outcome", "reason_codes")).count() == 0
    assert work.table("dead_letter", schemas.DEAD_LETTER).select("payload").distinct().count() == 1
    sent_on = spark.read.parquet(f"{root}/event_profile_normalized"), spark.read.parquet(f"{root}/event_decision_made")
    assert [e.count() for e in sent_on] == [150, 150]
    assert work.table("dead_letter_screen", schemas.DEAD_LETTER).count() == work.table("dead_letter_decide", schemas.DEAD_LETTER).count() == 0
    log = work.table("stage_log_decide", schemas.STAGE_LOG)
    assert log.where("duration_ms is null or duration_ms <= 0").count() == 0
    assert log.count() == 150 and log.where("status <> 'ok'").count() == 0

    # A replayed micro-batch writes the same rows again in place.
    last = max(r.batch_id for r in decided.select("batch_id").distinct().collect())
    again = work.table("screening", jobs.SCREENING_EVENT)
    work.decide_batch(again, last)
    assert work.table("decision", schemas.DECISION).count() == 150

    # A list change: one removal, one refused kind of change, one broken message.
    target = run.match.where("list_type = 'sanctions'").select("evidence_ref").first()[0]
    removed = run.entries.where(F.col("entry_id") == target).drop("j").first().asDict(recursive=True)
    payloads = [
        {"provider_id": "world_check", "list_type": "sanctions", "change": "remove", "entry": removed, "new_list_version": "v2"},
        {"provider_id": "world_check", "list_type": "sanctions", "change": "rename", "new_list_version": "v3"},
    ]
    values = [json.dumps({"trace_id": f"t{i}", "client_id": "world_check", "event_type": "watchlist.updated", "payload": json.dumps(p)}) for i, p in enumerate(payloads)]
    rows = [("watchlist.updated", 0, i, "world_check", v, None) for i, v in enumerate([*values, "{"])]
    spark.createDataFrame(rows, schemas.MESSAGE).write.parquet(f"{root}/updates/first")
    jobs.run_once(work.start_reconcile(events.read_topic_files(spark, f"{root}/updates/*"), once=True))
    runs = work.table("reconciliation_run", schemas.RECONCILIATION_RUN).collect()
    assert [(r.provider_id, r.old_version, r.new_version, r.clients_rescreened) for r in runs] == [("world_check", "v1", "v2", 150)]
    assert runs[0].newly_cleared >= 1 and runs[0].newly_flagged == 0
    assert work.table("dead_letter_reconcile", schemas.DEAD_LETTER).count() == 2
    assert work.all_screenings().count() == 300
    assert work.table("audit_rescreened", schemas.AUDIT).count() == 150

    # The same update again, in a later batch: skipped and logged. A new client is screened on the new list.
    spark.createDataFrame(rows[:1], schemas.MESSAGE).write.parquet(f"{root}/updates/second")
    jobs.run_once(work.start_reconcile(events.read_topic_files(spark, f"{root}/updates/*"), once=True))
    assert work.table("reconciliation_run", schemas.RECONCILIATION_RUN).count() == 1
    assert work.all_screenings().count() == 300
    log = work.table("stage_log_reconcile", schemas.STAGE_LOG).collect()
    assert sorted("idempotent_skip" in r.detail for r in log) == [False, True]
    late = sent.where("offset = 0").limit(1).withColumn("offset", F.lit(10**9).cast("bigint")).withColumn("value", F.regexp_replace("value", "19[0-9]{2}", "1901"))
    late.write.parquet(f"{root}/in/third")
    step()
    newest = work.table("screening", jobs.SCREENING_EVENT).orderBy(F.desc("batch_id")).first()
    assert newest.list_versions["world_check"] == "v2" and work.table("screening", jobs.SCREENING_EVENT).count() == 151
