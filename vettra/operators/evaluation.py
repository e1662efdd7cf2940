"""Labelled pairs and labelled decisions against what the engine says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettra.constants import MATCH_THRESHOLD
from vettra.functions.similarity import dob_relation, with_dob
from vettra.operators import decide as rules_engine
from vettra.operators.simjoin import with_similarity


def score_labelled(pairs: DataFrame) -> DataFrame:
    """Add score and predicted to (profile_name, candidate_name, dob_profile, dob_candidate, expected_match)."""
    relation = dob_relation(F.col("dob_profile"), F.col("dob_candidate"))
    scored = with_similarity(pairs, "profile_name", "candidate_name").withColumn("score", with_dob(F.col("base"), relation))
    return scored.drop("base").withColumn("predicted", F.col("score") >= MATCH_THRESHOLD)


def confusion(labelled: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn, below_min, precision, recall) from predicted, expected_match, score and min_score."""
    hit, truth = F.col("predicted"), F.col("expected_match")
    counts = labelled.agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.count_if(truth & (F.col("score") < F.col("min_score"))).alias("below_min"),
    )
    return counts.withColumns(
        {
            "precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0)),
            "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0)),
        }
    )


def evaluate_matches(pairs: DataFrame) -> DataFrame:
    return confusion(score_labelled(pairs))


def evaluate_decisions(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Decide labelled cases and compare; ``cases`` has case_id, matches and expected."""
    screening = cases.select(
        F.col("case_id").alias("screening_id"), F.col("case_id").alias("client_id"), F.col("case_id").alias("trace_id")
    )
    match = cases.select(F.col("case_id").alias("screening_id"), F.posexplode("matches").alias("i", "m")).select(
        "screening_id", "m.*", F.format_string("%09d", "i").alias("evidence_ref"), F.lit(None).cast("string").alias("match_id")
    )
    decided = rules_engine.decide(screening, match, rules).select(
        F.col("screening_id").alias("case_id"), "outcome", "reason_codes"
    )
    same = (F.col("outcome") == F.col("expected.outcome")) & (
        F.col("reason_codes") == F.sort_array("expected.reason_codes")
    )
    return cases.join(decided.hint("merge"), "case_id").withColumn("ok", same)
