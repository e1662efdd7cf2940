"""Registered queries: monitors, metrics, stage log, validators, sources and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra import schemas
from vettra.constants import PIPELINE_STAGES
from vettra.functions.fields import message_key
from vettra.operators import decide, evaluation, lists, metrics, monitors, normalize, screen, stagelog, validate
from vettra.plans import fixtures as fx
from vettra.plans import pipeline
from vettra.plans.oracle import LIST_TYPE, _sid, with_ctes
from vettra.plans.pipeline import Run, run_for
from vettra.plans.queries import _DECISIONS, _DRIFT, _OWN_SCORED, _SUBMITTED, _degraded_state, _submitted, _with_own_entry, joined, query
from vettra.operators import ingest
from vettra.session import shared_folder, stored
from vettra.sources import events, files, tables
from vettra.streaming import jobs


# ------------------------------------------------------------------------------------------------ monitors
def _k(column: str = "client_id") -> Column:
    return F.substring_index(F.col(column), "_", -1).cast("bigint")


class Tables(Mapping):
    """Tables by name, each built when it is first asked for: a monitor pays for no table that it does not read."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]):
        self.made, self.built = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self.made[name]()
        return self.built[name]

    def __iter__(self):
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


def golden_pairs(run: Run, upto: int = 2) -> DataFrame:
    """Each client beside the entry it was derived from, labelled; with 2 the hard negatives wrongly, so that recall drops."""
    return _with_own_entry(run.spark, run.sf_dir).select(
        F.col("canonical_name").alias("profile_name"),
        F.col("entity_name").alias("candidate_name"),
        F.col("dob_iso").alias("dob_profile"),
        F.col("entry_dob").alias("dob_candidate"),
        (F.col("k") % 15 <= upto).alias("expected_match"),
        F.lit(0.82).alias("min_score"),
    )


def faulty_tables(run: Run) -> Tables:
    """The run's tables with one fault per monitor, each tied to the client number."""
    return Tables(
        {
            "raw_profile": lambda: run.raw,
            "normalized_profile": lambda: faulty_profiles(run),
            "screening": lambda: faulty_screening(run),
            "match": lambda: run.match,
            "decision": lambda: faulty_decision(run),
            "audit": lambda: tampered(numbered_audit(run)),
            "audit_fingerprint": lambda: monitors.audit_fingerprint(numbered_audit(run)),
            "golden_matching": lambda: golden_pairs(run),
        }
    )


def faulty_profiles(run: Run) -> DataFrame:
    normalized = run.profiles.where(_k() % 97 != 5)
    return normalized.unionByName(normalized.where(_k() % 89 == 7)).withColumn(
        "profile_hash", F.when(_k() % 67 == 4, F.lit("bad")).otherwise(F.col("profile_hash"))
    )


def faulty_screening(run: Run) -> DataFrame:
    return run.screening.where(_k() % 83 != 11).withColumn(
        "list_versions",
        F.when(
            _k() % 71 == 1,
            F.map_concat(F.map_filter("list_versions", lambda p, _v: p != "world_check"), F.create_map(F.lit("world_check"), F.lit("v0"))),
        ).otherwise(F.col("list_versions")),
    )


def faulty_decision(run: Run) -> DataFrame:
    return run.decision.where(_k() % 79 != 3).withColumn(
        "trace_id", F.when(_k() % 73 == 2, F.concat("trace_id", F.lit("_x"))).otherwise(F.col("trace_id"))
    )


def numbered_audit(run: Run) -> DataFrame:
    return run.audit.withColumn("client", _k("trace_id")).withColumn("batch_id", F.col("client") % 10)


def tampered(audit: DataFrame) -> DataFrame:
    return audit.where("batch_id <> 4").withColumn(
        "snapshot", F.when(F.col("client") % 1000 == 9, F.lit("{}")).otherwise(F.col("snapshot"))
    )


_P, _D = "SELECT client_id AS breach FROM person WHERE ", "SELECT decision_id AS breach FROM decision WHERE "
_ACCURACY = (
    "SELECT printf('p=%.3f,r=%.3f', p, r) AS breach FROM (SELECT CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) "
    "END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM (SELECT count_if(score >= 0.82 AND "
    "k % 15 <= 2) AS tp, count_if(score >= 0.82 AND k % 15 > 2) AS fp, count_if(score < 0.82 AND k % 15 <= 2) AS fn "
    f"FROM ({_OWN_SCORED}) WHERE pos = 0)) WHERE p < 0.95 OR r < 0.9"
)
_HASH = "client_id || ':' || CASE WHEN k % 67 = 4 THEN 'bad' ELSE profile_hash END"
MONITOR_SQL = {
    "completeness": (_P + "k % 97 = 5 OR k % 89 = 7", ["person"]),
    "orphan_match": (
        f"SELECT {_sid('mat', 'screening_id || chr(124) || entry_id')} AS breach FROM match WHERE k % 83 = 11",
        ["match"],
    ),
    "orphan_decision": (_D + "k % 83 = 11 AND k % 79 <> 3", ["decision"]),
    "lineage": (_P + "k % 73 = 2 AND k % 79 <> 3", ["person"]),
    "decision_coverage": ("SELECT screening_id AS breach FROM person WHERE k % 79 = 3 AND k % 83 <> 11", ["person"]),
    "freshness": (_P + "k % 71 = 1 AND k % 83 <> 11", ["person"]),
    "idempotency": (f"SELECT {_HASH} AS breach FROM person WHERE k % 89 = 7 AND k % 97 <> 5", ["person"]),
    "audit_immutability": ("SELECT unnest(['4', '9']) AS breach", []),
    "determinism": (
        _P + "k % 67 = 4 AND k % 97 <> 5 UNION ALL " + _P + "k % 67 = 4 AND k % 97 <> 5 AND k % 89 = 7",
        ["person"],
    ),
    "match_accuracy": (_ACCURACY, []),
}


def _register_monitor(check: str, breaches) -> None:
    sql, needs = MONITOR_SQL[check]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return breaches(faulty_tables(run_for(spark, sf_dir)))

    run.__name__ = f"dq_{check}"
    run.__doc__ = f"Breaches of the {check} monitor on tables with known faults."
    query(with_ctes(sql, *needs))(run)


for _check, _risk, _breaches in monitors.CATALOG:
    _register_monitor(_check, _breaches)

_ALL_CHECKS = " UNION ALL ".join(
    f"SELECT {i} AS ord, '{check}' AS \"check\", count(*) = 0 AS passed, count(*)::BIGINT AS breach_count, "
    f"min(breach) AS first_breach FROM ({sql})"
    for i, (check, (sql, _)) in enumerate(MONITOR_SQL.items())
)


@query(with_ctes(_ALL_CHECKS, "person", "match", "decision", "entry", "ename"))
def dq_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = monitors.run_all(spark, faulty_tables(run_for(spark, sf_dir)))
    return results.select("ord", "check", "passed", "breach_count", F.get("breaches", F.lit(0)).alias("first_breach"))


@query(
    with_ctes(
        f"SELECT count(*)::BIGINT AS checks, count_if(passed)::BIGINT AS passed, array_to_string(list_sort(list(\"check\") "
        f"FILTER (NOT passed)), ',') AS breached FROM ({_ALL_CHECKS})",
        "person", "match", "decision", "entry", "ename",
    )
)
def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = monitors.run_all(spark, faulty_tables(run_for(spark, sf_dir)))
    return monitors.run_summary(results).select("checks", "passed", joined("breached").alias("breached"))


# ------------------------------------------------------------------------------------------------ metrics
@query(
    with_ctes(
        f"""
SELECT 'stage_rows' AS metric, label, value::DOUBLE AS value FROM (
  SELECT unnest(['ingest', 'normalize', 'screen', 'decide', 'audit']) AS label, (SELECT count(*) FROM person) AS value
  UNION ALL SELECT 'match', (SELECT count(*) FROM match))
UNION ALL SELECT 'decision_outcome', o, (SELECT count(*) FROM decision WHERE outcome = o)::DOUBLE
  FROM (SELECT unnest(['CLEAR', 'FLAG', 'ESCALATE']) AS o)
UNION ALL SELECT 'match_rate', '', (SELECT count(*) FROM match)::DOUBLE / (SELECT count(*) FROM person)
UNION ALL SELECT 'dead_letters', '', (SELECT count(*) FROM ({_SUBMITTED}) WHERE no_name OR no_nat)::DOUBLE
UNION ALL SELECT 'reconciliation_runs', '', (SELECT count(*) FROM supplier)::DOUBLE
UNION ALL SELECT 'reconciliation_newly_flagged', '', (SELECT count(*) FROM ({_DRIFT}) WHERE drift = 'newly_flagged')::DOUBLE
UNION ALL SELECT 'reconciliation_open', '', 0.0::DOUBLE""",
        "match", *_DECISIONS,
    )
)
def pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    tables = {
        "raw_profile": run.raw, "normalized_profile": run.profiles, "screening": run.screening, "match": run.match,
        "decision": run.decision, "audit": run.audit,
    }
    return (
        metrics.stage_rows(tables)
        .unionByName(metrics.decision_mix(run.decision))
        .unionByName(metrics.match_rate(run.match, run.screening))
        .unionByName(metrics.dead_letters(ingest.rejects(_submitted(spark, sf_dir))))
        .unionByName(metrics.reconciliation(run.reconciled.runs))
    )


@query(
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{metric}' AS metric, \"check\" AS label, {value} AS value FROM ({_ALL_CHECKS})"
            for metric, value in (("dq_breaches", "breach_count::DOUBLE"), ("dq_passed", "passed::INTEGER::DOUBLE"))
        ),
        "person", "match", "decision", "entry", "ename",
    )
)
def monitor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.monitor_metrics(monitors.run_all(spark, faulty_tables(run_for(spark, sf_dir))))


@query(
    with_ctes(
        "SELECT v.provider_id, CASE WHEN v.provider_id = 'dow_jones' THEN 'degraded' WHEN place > 1 THEN 'cache_hit' ELSE 'ok' "
        "END AS outcome, count(*)::BIGINT AS requests FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS place "
        "FROM person) CROSS JOIN (VALUES ('world_check'), ('dow_jones'), ('comply_advantage')) v(provider_id) GROUP BY 1, 2",
        "person",
    )
)
def provider_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    return metrics.provider_requests(screen.lookups(run.profiles, run.entries, _degraded_state(), None, "k"))


@query(
    f"SELECT CASE WHEN place = 1 THEN 'ok' ELSE 'duplicate' END AS status, count(*)::BIGINT AS submissions FROM (SELECT "
    f"row_number() OVER (PARTITION BY client_id ORDER BY o_orderkey) AS place FROM ({_SUBMITTED}) WHERE NOT no_name AND NOT no_nat) GROUP BY 1"
)
def ingest_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _submitted(spark, sf_dir).where(ingest.is_accepted())
    return metrics.ingest_by_status(ingest.with_ingest_status(accepted, "o_orderkey"))


@query(
    with_ctes(
        "SELECT (SELECT count(*) FROM person)::BIGINT AS screenings, count(DISTINCT k)::BIGINT AS with_match, "
        "max(score)::DOUBLE AS max_score FROM match",
        "match", "person",
    )
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_summary(run_for(spark, sf_dir).screening)


_SKETCH_ERROR = 0.02  # a KLL sketch of the default size misses a rank by at most 1.7 % with a chance of 99 %


def _checked_quantiles(rows: DataFrame, sketches: DataFrame, key: str, value: str) -> DataFrame:
    """Quantiles of merged sketches, and whether the exact ranks of the values found are close to those asked for."""
    found = metrics.quantiles(metrics.merged_sketches(sketches, key), 0.1, 0.5, 0.9, 0.99)
    told = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x")).groupBy(key, "x").agg(
        F.count(F.lit(1)).alias("c")
    )
    ranked = told.join(found, key).groupBy(key, "n", "rank", "value").agg(
        F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)).alias("up_to"),
    )
    near = (F.col("below") <= (F.col("rank") + _SKETCH_ERROR) * F.col("n")) & (
        F.col("up_to") >= (F.col("rank") - _SKETCH_ERROR) * F.col("n")
    )
    return ranked.select(key, F.col("n").cast("bigint").alias("n"), "rank", near.alias("near"))


_RANKS = "(SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS rank)"


@query(
    with_ctes(
        f"SELECT list_type, n, rank, true AS near FROM (SELECT list_type, count(*)::BIGINT AS n FROM match GROUP BY 1), {_RANKS}",
        "match",
    )
)
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match scores: a sketch per list and batch of clients, merged per list."""
    rows = run_for(spark, sf_dir).match.withColumn("batch", _k("client_id") % 7)
    return _checked_quantiles(rows, metrics.quantile_sketches(rows, "score", "list_type", "batch"), "list_type", "score")


@query(
    f"SELECT event_type, n, rank, true AS near FROM (SELECT event_type, count(value)::BIGINT AS n FROM events GROUP BY 1 "
    f"HAVING count(value) > 0), {_RANKS}"
)
def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events: a sketch per type and hour, merged per type."""
    rows = fx.table(spark, sf_dir, "events")
    return _checked_quantiles(rows, metrics.quantile_sketches(rows, "value", "event_type", ts="ts"), "event_type", "value")


_THROUGHPUT = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS topic, count(*)::BIGINT AS rows "
    "FROM events GROUP BY 1, 2"
)


def _throughput_view(rows: DataFrame) -> DataFrame:
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "topic", "rows")


@query(_THROUGHPUT)
def stage_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throughput_view(metrics.throughput(fx.messages(spark, sf_dir), "1 hour", "produced_at", "topic"))


# ------------------------------------------------------------------------------------------------ stage log
def _faulty_log(run: Run) -> DataFrame:
    """Four stage rows per client, some lost, some doubled, some out of order."""
    step = F.posexplode(F.array(*[F.lit(s) for s in PIPELINE_STAGES])).alias("i", "stage")
    k = F.col("k")
    rows = run.raw.select("k", "client_id", "trace_id", step)
    late = F.when((k % 61 == 3) & (F.col("stage") == "decide"), -10).otherwise(0)
    rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + k * 10 + F.col("i") + late))
    rows = rows.where(~((k % 53 == 1) & (F.col("stage") == "normalize")))
    twice = rows.where((k % 59 == 2) & (F.col("stage") == "screen"))
    return rows.unionByName(twice).withColumn("status", F.lit("ok"))


@query(
    "SELECT 'trc_' || c_custkey AS trace_id, CASE WHEN c_custkey % 53 = 1 THEN 'missing' WHEN c_custkey % 59 = 2 THEN "
    "'duplicate' ELSE 'order' END AS problem FROM customer WHERE c_custkey % 53 = 1 OR c_custkey % 59 = 2 OR c_custkey % 61 = 3"
)
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stagelog.stage_gaps(_faulty_log(run_for(spark, sf_dir)))


@query(
    with_ctes(
        "SELECT p.screening_id, (coalesce(m.n, 0) + CASE WHEN p.k % 43 = 1 THEN 1 ELSE 0 END)::BIGINT AS logged, "
        "coalesce(m.n, 0)::BIGINT AS stored, coalesce(m.n, 0)::BIGINT AS published FROM person p LEFT JOIN "
        "(SELECT k, count(*) AS n FROM match GROUP BY 1) m ON p.k = m.k WHERE p.k % 43 = 1",
        "person", "match",
    )
)
def match_count_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    log = run.screening.select("screening_id", (F.col("matches") + F.when(_k() % 43 == 1, 1).otherwise(0)).alias("logged"))
    event = run.screening.select("screening_id", F.col("matches").alias("published"))
    return stagelog.match_count_mismatches(log, run.match, event)


_EVENT_KEY = "user_id || ':' || event_type || ':' || (event_id % 3) || ':' || (event_id // 3)"


@query(
    f"SELECT {_EVENT_KEY} AS message_key, 'no_dead_letter' AS problem FROM events WHERE event_type = 'error' AND event_id % 7 = 3 "
    f"UNION ALL SELECT {_EVENT_KEY}, 'no_failed_log' FROM events WHERE event_type = 'signup' AND event_id % 7 = 4 "
    f"UNION ALL SELECT {_EVENT_KEY}, 'partial_write' FROM events WHERE event_type = 'error' AND event_id % 11 = 5"
)
def failure_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events stand for failed log rows; some lack a dead letter, some left a row behind."""
    key = message_key(F.col("trace_id"), F.col("topic"), F.col("partition"), F.col("offset"))
    rows = fx.messages(spark, sf_dir).withColumn("message_key", key)
    e, topic = F.col("event_id"), F.col("topic")
    log = rows.withColumn("status", F.when(topic == "error", "failed").otherwise("ok"))
    dead = rows.where(((topic == "error") & (e % 7 != 3)) | ((topic == "signup") & (e % 7 == 4)))
    written = rows.where((topic != "error") | (e % 11 == 5))
    return stagelog.failure_mismatches(log, dead, written)


@query(
    with_ctes(
        "SELECT v.provider_id, sha256(name) AS name_hash, count(*)::BIGINT AS lookups, (count(*) - 1)::BIGINT AS hits FROM person "
        "CROSS JOIN (VALUES ('world_check'), ('dow_jones'), ('comply_advantage')) v(provider_id) GROUP BY 1, 2",
        "person",
    )
)
def reuse_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stagelog.reuse_by_name(run_for(spark, sf_dir).lookup)


# ------------------------------------------------------------------------------------------------ validators
def faulty_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries with one fault each, by entry number."""
    j = F.col("j")
    case = j % 13
    other = j - 8
    other_list = F.when(other % 3 == 0, "sanctions").when(other % 3 == 1, "pep").otherwise("adverse_media")
    rows = fx.entries(spark, sf_dir).withColumn("served_as", F.col("list_type"))
    return rows.withColumns(
        {
            "aliases": F.when(case == 0, F.concat("aliases", F.array(F.concat("entity_name", F.lit("ff")))))
            .when(case == 7, F.concat("aliases", "aliases"))
            .when(case == 9, F.concat("aliases", F.array(F.lit(" "))))
            .otherwise(F.col("aliases")),
            "country_iso2": F.when(case == 1, "RUS").otherwise(F.col("country_iso2")),
            "dob_iso": F.when(case == 2, "1972-13-40").otherwise(F.col("dob_iso")),
            "entity_name": F.when(case == 3, "  ").otherwise(F.col("entity_name")),
            "entry_id": F.when(case == 4, F.concat(F.lit("sanctions_"), j.cast("string")))
            .when((case == 8) & (other >= 0), fx.entry_id(other_list, other))
            .otherwise(F.col("entry_id")),
            "provider_id": F.when(case == 5, F.lit("nobody")).otherwise(F.col("provider_id")),
            "risk_payload": F.when(case != 6, F.col("risk_payload")),
            "list_type": F.when(case == 10, F.lit("other")).otherwise(F.col("list_type")),
        }
    )


_L = LIST_TYPE.format(j="j")
_LO = LIST_TYPE.format(j="(j - 8)")
_FAULTS = f"""
SELECT "check", list || '.jsonl:' || eid AS locator FROM (
  SELECT j, list, CASE j % 13 WHEN 4 THEN 'sanctions_' || j WHEN 8 THEN 'wl_' || {_LO} || '_' || printf('%04d', j - 8)
         ELSE 'wl_' || list || '_' || printf('%04d', j) END AS eid,
         unnest(CASE j % 13 WHEN 0 THEN ['implausible_alias'] WHEN 1 THEN ['bad_country'] WHEN 2 THEN ['bad_dob']
           WHEN 3 THEN ['empty_entity_name'] WHEN 4 THEN ['entry_id_format'] WHEN 5 THEN ['provider_mismatch']
           WHEN 6 THEN [CASE list WHEN 'sanctions' THEN 'missing_program' WHEN 'pep' THEN 'bad_pep_tier'
                        ELSE 'bad_media_confidence' END]
           WHEN 7 THEN ['duplicate_alias'] WHEN 8 THEN ['entry_id_format'] WHEN 9 THEN ['empty_alias']
           WHEN 10 THEN ['list_type_mismatch'] ELSE []::VARCHAR[] END) AS "check"
  FROM (SELECT s_suppkey AS j, {LIST_TYPE.format(j='s_suppkey')} AS list FROM supplier))
UNION ALL
SELECT 'duplicate_entry_id', 'wl_' || {_LO} || '_' || printf('%04d', j - 8) FROM (SELECT s_suppkey AS j FROM supplier) WHERE j % 13 = 8"""


@query(_FAULTS)
def watchlist_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.watchlist_violations(faulty_entries(spark, sf_dir), F.col("served_as")).select("check", "locator")


@query(f'SELECT "check", count(*)::BIGINT AS violations FROM ({_FAULTS}) GROUP BY 1')
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.watchlist_violations(faulty_entries(spark, sf_dir), F.col("served_as"))
    return validate.counts_by_check(found)


@query(
    "SELECT 'manifest_count' AS \"check\", list || '.jsonl' AS locator FROM (SELECT DISTINCT "
    f"{LIST_TYPE.format(j='s_suppkey')} AS list FROM supplier) WHERE list <> 'sanctions' UNION ALL "
    "SELECT 'dangling_plant_target', 'manifest.json' FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)"
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fx.entries(spark, sf_dir)
    declared = entries.groupBy("list_type").agg(F.count(F.lit(1)).alias("n")).select(
        "list_type", (F.col("n") + F.when(F.col("list_type") == "sanctions", 0).otherwise(1)).alias("count")
    )
    twice = F.col("j") * 2
    list_type = F.when(twice % 3 == 0, "sanctions").when(twice % 3 == 1, "pep").otherwise("adverse_media")
    targets = entries.select(fx.entry_id(list_type, twice).alias("entry_id"))
    return validate.manifest_violations(declared, targets, entries).select("check", "locator")


@query(
    with_ctes(
        "SELECT count_if(hit AND t)::BIGINT AS tp, count_if(hit AND NOT t)::BIGINT AS fp, count_if(NOT hit AND t)::BIGINT AS fn, "
        "count_if(NOT hit AND NOT t)::BIGINT AS tn FROM (SELECT score >= 0.82 AS hit, k % 15 <= 1 AS t "
        f"FROM ({_OWN_SCORED}) WHERE pos = 0)"
    )
)
def match_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted profiles against their own entry: exact and perturbed names should match, the others should not."""
    labelled = golden_pairs(run_for(spark, sf_dir), upto=1)
    return evaluation.evaluate_matches(labelled).select("tp", "fp", "fn", "tn")


@query(
    """
SELECT l_orderkey, CASE coalesce(max(sev), 1) WHEN 3 THEN 'ESCALATE' WHEN 2 THEN 'FLAG' ELSE 'CLEAR' END AS outcome,
       coalesce(nullif(array_to_string(list_sort(list_distinct(list(rule) FILTER (rule IS NOT NULL))), ','), ''), 'NO_MATCH') AS reason_codes
FROM (SELECT l_orderkey, CASE WHEN score < 0.82 THEN NULL WHEN kind = 'R' THEN 'SANCTIONS_MATCH' WHEN kind = 'N' THEN 'ADVERSE_MEDIA'
             WHEN tier IN (1, 2) THEN 'PEP_TIER_1_2' WHEN tier IN (3, 4) THEN 'PEP_TIER_3_4' END AS rule,
             CASE WHEN score < 0.82 THEN NULL WHEN kind = 'R' THEN 3 WHEN kind = 'N' THEN 2
             WHEN tier IN (1, 2) THEN 3 WHEN tier IN (3, 4) THEN 2 END AS sev
      FROM (SELECT l_orderkey, l_returnflag AS kind, (78 + l_linenumber) / 100.0::DOUBLE AS score,
                   l_quantity::INTEGER % 6 AS tier FROM lineitem)) GROUP BY 1"""
)
def decide_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for matches of their order: every rule path, scores around the floor, tiers out of range."""
    flag = F.col("l_returnflag")
    match = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("screening_id"),
        F.when(flag == "R", "sanctions").when(flag == "N", "adverse_media").otherwise("pep").alias("list_type"),
        ((78 + F.col("l_linenumber")) / F.lit(100.0)).alias("score"),
        (F.col("l_quantity").cast("int") % 6).alias("pep_tier"),
        F.col("l_linenumber").cast("string").alias("evidence_ref"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("match_id"),
    )
    screening = match.select("screening_id").distinct().withColumns({"client_id": F.lit(""), "trace_id": F.lit("")})
    decided = decide.decide(screening, match, decide.rules_table(spark))
    return decided.select(
        F.col("screening_id").alias("l_orderkey"), "outcome", joined("reason_codes").alias("reason_codes")
    )


_MIX = {"clean": 50, "dirty": 20, "edge": 12, "adversarial": 8}


@query(
    "WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 5 THEN 'clean' WHEN c_custkey % 10 < 7 THEN 'dirty' "
    "WHEN c_custkey % 10 < 9 THEN 'edge' ELSE 'adversarial' END AS category, "
    "'cli_' || (c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END) AS client_id FROM customer) "
    "SELECT 'category_mix' AS \"check\", m.category AS locator FROM (VALUES ('clean', 50), ('dirty', 20), ('edge', 12), "
    "('adversarial', 8)) m(category, share) LEFT JOIN (SELECT category, count(*) AS n FROM p GROUP BY 1) c USING (category) "
    "WHERE abs(coalesce(n, 0) * 100 - (SELECT count(*) FROM p) * share) > 100 UNION ALL "
    "SELECT 'unknown_expected_match', client_id FROM p WHERE k % 4 = 0 AND k // 2 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL "
    "SELECT 'duplicate_client_id', client_id FROM p GROUP BY client_id HAVING count(*) > 1"
)
def profile_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a profile set: two shares off, some ids twice, some expected entries on no list."""
    k = F.col("c_custkey").cast("bigint")
    half = F.floor(k / 2).cast("bigint")
    list_type = F.when(half % 3 == 0, "sanctions").when(half % 3 == 1, "pep").otherwise("adverse_media")
    profiles = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cli_"), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string")).alias("client_id"),
        F.when(k % 10 < 5, "clean").when(k % 10 < 7, "dirty").when(k % 10 < 9, "edge").otherwise("adversarial").alias("category"),
        F.when(k % 4 == 0, fx.entry_id(list_type, half)).alias("expected_match_entry_id"),
    )
    return validate.profile_set_violations(profiles, fx.entries(spark, sf_dir), _MIX).select("check", "locator")


@query("SELECT 'golden_norm_drift' AS \"check\", 'cli_' || c_custkey AS locator FROM customer WHERE c_custkey % 10 = 0")
def golden_norm_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with the form they should take; every tenth expects another name."""
    raw = fx.submissions(spark, sf_dir)
    given = F.struct(*ingest.PAYLOAD).alias("input")
    known = normalize.normalize(raw.select("k", "client_id", given, *ingest.PAYLOAD))
    expected = normalize.golden_expected().withField(
        "canonical_name", F.when(F.col("k") % 10 == 0, "somebody else").otherwise(F.col("canonical_name"))
    )
    golden = known.select(F.col("client_id").alias("locator"), "input", expected.alias("expected"))
    return validate.golden_norm_violations(golden).select("check", "locator")


@query(
    " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", o_orderkey::VARCHAR AS locator FROM orders WHERE o_orderkey % {n} = 0"
        for check, n in (
            ("golden_match_empty_name", 7), ("golden_match_label", 11), ("golden_match_min_score", 13), ("golden_match_dob", 17),
            ("golden_decision_outcome", 5), ("golden_decision_codes", 9),
        )
    )
)
def golden_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs and decisions, one per order, with a fault each for some orders."""
    o = F.col("o_orderkey")

    def fault(n: int, bad, good) -> Column:
        return F.when(o % n == 0, bad).otherwise(good)

    rows = fx.table(spark, sf_dir, "orders").select(
        o.cast("string").alias("locator"),
        fault(7, " ", "ann lee").alias("profile_name"),
        F.lit("ann li").alias("candidate_name"),
        fault(11, F.lit(None).cast("boolean"), True).alias("expected_match"),
        fault(13, 1.5, 0.82).alias("min_score"),
        fault(17, "1999-02-30", "1999-02-03").alias("dob_profile"),
        F.lit(None).cast("string").alias("dob_candidate"),
        F.struct(
            fault(5, "MAYBE", "CLEAR").alias("outcome"),
            fault(9, F.array().cast("array<string>"), F.array(F.lit("NO_MATCH"))).alias("reason_codes"),
        ).alias("expected"),
    )
    both = validate.all_violations(validate.golden_match_violations(rows), validate.golden_decision_violations(rows))
    return both.select("check", "locator")


@query(
    with_ctes(
        f"SELECT \"check\", breach_count FROM ({_ALL_CHECKS}) WHERE NOT passed", "person", "match", "decision", "entry", "ename"
    )
)
def breach_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the breach sink holds after the same run was written twice."""
    results = stored(monitors.run_all(spark, faulty_tables(run_for(spark, sf_dir))), "dq_results")
    root = f"{shared_folder(spark)}/breaches-{uuid.uuid4().hex}"
    for _ in range(2):
        tables.write_breaches(monitors.breach_records(results), root, "first")
    return spark.read.schema("`check` string, breach_count bigint").json(f"{root}/dq_breach").select("check", "breach_count")


# ------------------------------------------------------------------------------------------------ sources and streams
@query(
    with_ctes(
        "SELECT entry_id, list_type AS served_as, entity_name, array_to_string(aliases, ',') AS aliases, dob::VARCHAR AS dob_iso, "
        "pep_tier FROM entry",
        "entry",
    )
)
def watchlist_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists written as one JSON file each and read back with their declared schema."""
    root = f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}"
    entries = fx.entries(spark, sf_dir).drop("j")
    for list_type, name in files.LIST_FILES.items():
        entries.where(F.col("list_type") == list_type).write.json(f"{root}/{name}")
    return files.read_watchlists(spark, root).select(
        "entry_id", "served_as", "entity_name", joined("aliases").alias("aliases"), "dob_iso", "risk_payload.pep_tier"
    )



_FINGERPRINT = (
    "SELECT 'customer' AS dataset, count(*)::BIGINT AS rows, sum(('0x' || substr(md5(c_acctbal || '|' || c_custkey || '|' || "
    "c_mktsegment || '|' || c_name || '|' || c_nationkey), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM customer"
)


@query(_FINGERPRINT)
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.fingerprint(fx.table(spark, sf_dir, "customer")).select(F.lit("customer").alias("dataset"), "rows", "digest")


def submission_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's submission as a delivered message, every tenth twice and every fiftieth also as broken JSON."""
    k = F.col("k")
    rows = fx.submissions(spark, sf_dir)
    event = events.envelope("client.submitted", "ingestion-api", ingest.kyc_payload(), F.col("created_at"))
    base = rows.select("k", "created_at", F.col("client_id").alias("key"), F.to_json(event).alias("value"))
    again = base.where(k % 10 == 0)
    broken = base.where(k % 50 == 0).select(
        (k + 1_000_000_000).alias("k"), "created_at", "key", F.lit('{"trace_id": "t').alias("value")
    )
    return (
        base.unionByName(again)
        .unionByName(broken)
        .select(
            F.lit("client.submitted").alias("topic"),
            (k % 3).cast("int").alias("partition"),
            F.floor(k / 3).cast("bigint").alias("offset"),
            "key",
            "value",
            F.col("created_at").alias("timestamp"),
        )
    )


@query(
    "SELECT c_custkey % 3 AS \"partition\", count(*)::BIGINT AS messages, count_if(c_custkey % 10 = 0)::BIGINT AS repeats "
    "FROM customer GROUP BY 1"
)
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = events.parse(submission_messages(spark, sf_dir)).where("error is null")
    per_key = parsed.groupBy("message_key", F.col("partition").cast("bigint").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("partition").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("n") > 1).alias("repeats")
    )


@query("SELECT 'normalize' AS stage, 'invalid_json' AS error_type, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 50 = 0")
def poison_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = events.dead_letters(events.parse(submission_messages(spark, sf_dir)), "normalize", F.col("timestamp"))
    return letters.groupBy("stage", "error_type").agg(F.count(F.lit(1)).alias("n"))


def _stream_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(
        "event_id", F.col("event_type").alias("topic"), F.col("ts").cast("timestamp").alias("produced_at")
    )


@query("SELECT event_id, event_type AS topic FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delivered twice leave the stream once."""
    root = _stream_root(spark)
    once = _event_stream(spark, sf_dir)
    delivered = once.unionByName(_event_stream(spark, sf_dir).where("event_id % 10 = 0"))
    kept = jobs.deduplicated(delivered, ["event_id"], "produced_at", "1 hour")
    jobs.run_once(
        kept.writeStream.format("parquet")
        .option("path", f"{root}/kept")
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    return spark.read.parquet(f"{root}/kept").select("event_id", "topic")


@query(_THROUGHPUT)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per topic and hour of a stream; each trigger rewrites the windows that changed."""
    root = _stream_root(spark)
    counted = metrics.throughput(
        _event_stream(spark, sf_dir).withWatermark("produced_at", "1 hour"), "1 hour", "produced_at", "topic"
    )

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")

    jobs.run_once(
        counted.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    rows = spark.read.schema("window_start timestamp, topic string, rows bigint, batch_id int").parquet(f"{root}/rows")
    latest = rows.groupBy("window_start", "topic").agg(F.max_by("rows", "batch_id").alias("rows"))
    return _throughput_view(latest)


@query(with_ctes("SELECT client_id, trace_id, outcome, reason_codes FROM decision", "decision"))
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions through the normalize, screen and decide streams; the decisions equal the batch run's."""
    root, run = _stream_root(spark), run_for(spark, sf_dir)
    submission_messages(spark, sf_dir).write.parquet(f"{root}/client_submitted")
    work = jobs.Jobs(spark, root, lambda: (run.entries, lists.default_state()))
    jobs.run_once(work.start_normalize(events.read_topic_files(spark, f"{root}/client_submitted"), once=True))
    jobs.run_once(work.start_screen(once=True))
    jobs.run_once(work.start_decide(once=True))
    decided = work.table("decision", schemas.DECISION)
    return decided.select("client_id", "trace_id", "outcome", joined("reason_codes").alias("reason_codes"))


def update_messages(updates: DataFrame) -> DataFrame:
    """List updates as delivered messages of the one-partition topic, in their order."""
    payload = F.struct("provider_id", "list_type", "change", "entry", "new_list_version")
    told = updates.withColumns({"trace_id": F.concat(F.lit("upd_"), F.col("seq")), "client_id": F.col("provider_id")})
    event = events.envelope("watchlist.updated", "list-feed", payload, pipeline.at(pipeline.RESCREEN_AT))
    return told.select(
        F.lit("watchlist.updated").alias("topic"), F.lit(0).alias("partition"), F.col("seq").cast("bigint").alias("offset"),
        F.col("provider_id").alias("key"), F.to_json(event).alias("value"), pipeline.at(pipeline.RESCREEN_AT).alias("timestamp"),
    )


def stored_run(spark: SparkSession, sf_dir: str, root: str) -> jobs.Jobs:
    """Jobs over a folder that holds the run's profiles, screenings, matches and decisions as published batches."""
    run = run_for(spark, sf_dir)
    work = jobs.Jobs(spark, root, lambda: (run.entries.drop("j"), lists.default_state()))
    parts = {"normalized_profile": run.profiles, "screening": run.screening, "match": run.match, "decision": run.decision}
    for name, rows in parts.items():
        if name == "match":
            rows = rows.withColumn("score", F.col("score").cast("decimal(5,4)"))
        tables.write_batch(rows, root, name, 0)
    for job, names in (("normalize", ["normalized_profile"]), ("screen", ["screening", "match"]), ("decide", ["decision"])):
        tables.publish(spark, root, job, 0, names)
    return work


@query(
    with_ctes(
        "SELECT e.entry_id, e.entity_name, CASE WHEN u.j IS NULL THEN 'v1' ELSE 'v3' END AS list_version, true AS is_active "
        "FROM entry e LEFT JOIN (SELECT j FROM upd WHERE change = 'remove') u ON e.j = u.j",
        "entry", "upd",
    )
)
def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries removed in one batch and added again under other names in the next: the mirror outlives the batches."""
    root, run = _stream_root(spark), run_for(spark, sf_dir)
    work = stored_run(spark, sf_dir, root)
    removed = run.updates.where("change = 'remove'")
    again = removed.withColumns({"change": F.lit("add"), "new_list_version": F.lit("v3"), "seq": F.col("seq") + 1_000_000})
    for name, batch in (("first", removed), ("second", again)):
        update_messages(batch).write.parquet(f"{root}/updates/{name}")
        jobs.run_once(work.start_reconcile(events.read_topic_files(spark, f"{root}/updates/*"), once=True))
    shape = "entry_id string, entity_name string, list_version string, is_active boolean"
    mirror = work.table("list_mirror", shape).where(F.col("batch_id") == work.last_lists())
    return mirror.select("entry_id", "entity_name", "list_version", "is_active")


@query(
    with_ctes(
        "SELECT 'invalid_json' AS error_type, ((k + 1000000000) % 3)::INTEGER AS part, (k + 1000000000) // 3 AS place FROM base "
        "WHERE k % 50 = 0 UNION ALL SELECT 'missing_raw_profile', (k % 3)::INTEGER, k // 3 FROM base WHERE k % 7 = 0",
        "base",
    )
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken messages, and submissions of clients without a raw profile, leave the normalize stream as dead letters."""
    root, run = _stream_root(spark), run_for(spark, sf_dir)
    submission_messages(spark, sf_dir).write.parquet(f"{root}/client_submitted")
    raw = run.raw.where("k % 7 <> 0")
    work = jobs.Jobs(spark, root, lambda: (run.entries, lists.default_state()), raw=lambda: raw)
    jobs.run_once(work.start_normalize(events.read_topic_files(spark, f"{root}/client_submitted"), once=True))
    bad = work.table("dead_letter", schemas.DEAD_LETTER)
    return bad.select("error_type", F.col("partition").alias("part"), F.col("offset").alias("place")).distinct()


class BrokenOff(RuntimeError):
    """Stands for an executor or driver lost in the middle of a batch."""


@query(with_ctes("SELECT 'cli_' || k AS client_id, name AS canonical_name, (k % 3)::INTEGER AS batch FROM base", "base"))
def stream_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches; each breaks off after its second table was written, is not seen by readers, and runs again."""
    root, run = _stream_root(spark), run_for(spark, sf_dir)
    sent = submission_messages(spark, sf_dir)

    class Breaking(jobs.Jobs):
        def write(self, rows: DataFrame, table: str, batch_id: int) -> None:
            super().write(rows, table, batch_id)
            if table == "normalized_profile":
                raise BrokenOff

    arguments = spark, root, lambda: (run.entries, lists.default_state())
    for batch in range(3):
        own = sent.where(F.col("partition") == batch)
        try:
            Breaking(*arguments).normalize_batch(own, batch)
        except BrokenOff:
            pass
        seen = jobs.Jobs(*arguments).table("normalized_profile", schemas.NORMALIZED_PROFILE)
        if not seen.where(F.col("batch_id") == batch).isEmpty():
            raise AssertionError("rows of an unpublished batch were read")
        jobs.Jobs(*arguments).normalize_batch(own, batch)
    rows = jobs.Jobs(*arguments).table("normalized_profile", schemas.NORMALIZED_PROFILE)
    return rows.select("client_id", "canonical_name", F.col("batch_id").alias("batch"))
