"""Decisions: matches joined with a rules table, reduced to one explained outcome per screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.constants import NO_MATCH_CODE, RULES, SEVERITY
from vettra.functions.fields import stable_id
from vettra.operators.lists import list_order

RULE_SCHEMA = "rule_ord int, rule string, list_type string, outcome string, min_score double, tiers array<int>"
MAX_RULES = 10_000


def rules_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """Rules as data. The table is configuration, bounded by ``MAX_RULES``, so it may be broadcast."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = [(i, code, lt, outcome, float(low), tiers) for i, (code, lt, outcome, low, tiers) in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def severity(outcome: Column) -> Column:
    pairs = [F.lit(x) for pair in SEVERITY.items() for x in pair]
    return F.create_map(*pairs)[outcome]


def triggers(match: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (rule, match) that fires. A politically exposed person with an unknown tier fires nothing."""
    applies = (F.coalesce(F.col("score"), F.lit(0.0)) >= F.col("min_score")) & (
        F.col("tiers").isNull() | F.coalesce(F.array_contains("tiers", F.col("pep_tier")), F.lit(False))
    )
    return match.join(F.broadcast(rules), "list_type").where(applies)


def _match_order() -> list[Column]:
    return [list_order(F.col("list_type")).alias("list_ord"), F.col("evidence_ref").alias("entry_ord")]


def rule_trace(match: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per trigger, with the orders that place it: rule first, then match."""
    return triggers(match, rules).select(
        "screening_id",
        "rule_ord",
        *_match_order(),
        "rule",
        "list_type",
        "outcome",
        "score",
        "pep_tier",
        F.coalesce("match_id", "evidence_ref").alias("match_ref"),
    )


def decide(screening: DataFrame, match: DataFrame, rules: DataFrame, decided_at: Column | None = None) -> DataFrame:
    """One decision per screening: highest severity, all reason codes, and the best match behind that outcome.

    One pass over the triggers of a screening: the codes are at most the rules, and the first trigger by severity, score
    and place names both the outcome and the match.
    """
    fired = triggers(match, rules).select(
        "screening_id", "rule", "outcome", "match_id", "score", "rule_ord", *_match_order()
    )
    first = F.struct(-severity(F.col("outcome")), -F.col("score"), F.col("rule_ord"), F.col("list_ord"), F.col("entry_ord"))
    final = fired.groupBy("screening_id").agg(
        F.min_by(F.struct("outcome", F.col("match_id").alias("top_match_id")), first).alias("top"),
        F.sort_array(F.collect_set("rule")).alias("codes"),
    )
    return screening.join(final.hint("merge"), "screening_id", "left").select(
        stable_id("dec", F.col("screening_id")).alias("decision_id"),
        "screening_id",
        "client_id",
        "trace_id",
        F.coalesce("top.outcome", F.lit("CLEAR")).alias("outcome"),
        F.coalesce("codes", F.array(F.lit(NO_MATCH_CODE))).alias("reason_codes"),
        F.col("top.top_match_id").alias("top_match_id"),
        (F.current_timestamp() if decided_at is None else decided_at).alias("decided_at"),
    )


def audit(screening: DataFrame, match: DataFrame, decision: DataFrame, rules: DataFrame) -> DataFrame:
    """One append-only audit row per decision, holding all that is needed to defend it as JSON.

    The snapshot nests one client's own matches; the page-wise lookup bounds them to a page per provider.
    """
    item = F.struct(
        *_match_order(),
        F.struct(
            "match_id", "provider_id", "list_type", "matched_name", "score", "dob_match", "evidence_ref", "pep_tier",
            "media_confidence",
        ).alias("m"),
    )
    matched = match.groupBy("screening_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.m).alias("matches")
    )
    step = F.struct(
        "rule_ord",
        "list_ord",
        "entry_ord",
        F.struct("rule", "list_type", "outcome", "score", "pep_tier", "match_ref").alias("t"),
    )
    traced = (
        rule_trace(match, rules)
        .groupBy("screening_id")
        .agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x.t).alias("rule_trace"))
    )
    facts = screening.select("screening_id", "profile_hash", "list_versions")
    joined = (
        decision.join(facts.hint("merge"), "screening_id")
        .join(matched.hint("merge"), "screening_id", "left")
        .join(traced.hint("merge"), "screening_id", "left")
    )
    snapshot = F.to_json(
        F.struct(
            "screening_id",
            "client_id",
            "trace_id",
            "profile_hash",
            "list_versions",
            F.coalesce("matches", F.array().cast(matched.schema["matches"].dataType)).alias("matches"),
            F.coalesce("rule_trace", F.array().cast(traced.schema["rule_trace"].dataType)).alias("rule_trace"),
            "outcome",
            "reason_codes",
        )
    )
    return joined.select(
        stable_id("aud", F.col("decision_id")).alias("audit_id"),
        "decision_id",
        "trace_id",
        snapshot.alias("snapshot"),
        F.col("decided_at").alias("created_at"),
    )
