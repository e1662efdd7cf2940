from __future__ import annotations

import json

from pyspark.sql import functions as F

from vettra.constants import RULES
from vettra.operators import decide, evaluation

S, P, M = "sanctions", "pep", "adverse_media"
# matches as (list_type, score, tier, confidence) -> outcome, codes
GOLDEN = [
    ([(S, 0.93, None, None)], "ESCALATE", ["SANCTIONS_MATCH"]),
    ([(P, 0.90, 1, None)], "ESCALATE", ["PEP_TIER_1_2"]),
    ([(P, 0.88, 2, None)], "ESCALATE", ["PEP_TIER_1_2"]),
    ([(P, 0.91, 3, None)], "FLAG", ["PEP_TIER_3_4"]),
    ([(P, 0.95, 4, None)], "FLAG", ["PEP_TIER_3_4"]),
    ([(M, 0.90, None, 0.9)], "FLAG", ["ADVERSE_MEDIA"]),
    ([], "CLEAR", ["NO_MATCH"]),
    ([(S, 0.90, None, None), (P, 0.90, 3, None)], "ESCALATE", ["PEP_TIER_3_4", "SANCTIONS_MATCH"]),
    ([(P, 0.90, 3, None), (M, 0.88, None, 0.8)], "FLAG", ["ADVERSE_MEDIA", "PEP_TIER_3_4"]),
    ([(S, 0.95, None, None), (M, 0.90, None, 0.85)], "ESCALATE", ["ADVERSE_MEDIA", "SANCTIONS_MATCH"]),
    ([(P, 0.92, 2, None), (M, 0.85, None, 0.7)], "ESCALATE", ["ADVERSE_MEDIA", "PEP_TIER_1_2"]),
    ([(P, 0.90, 1, None), (P, 0.90, 4, None)], "ESCALATE", ["PEP_TIER_1_2", "PEP_TIER_3_4"]),
    # beyond the golden set: below the floor, unknown tier, missing score
    ([(S, 0.8199, None, None)], "CLEAR", ["NO_MATCH"]),
    ([(P, 0.99, None, None), (P, 0.99, 7, None)], "CLEAR", ["NO_MATCH"]),
    ([(S, None, None, None)], "CLEAR", ["NO_MATCH"]),
    ([(S, 0.82, None, None)], "ESCALATE", ["SANCTIONS_MATCH"]),
]


def test_golden_decisions(spark):
    cases = spark.createDataFrame(
        [(str(i), m, (o, c)) for i, (m, o, c) in enumerate(GOLDEN)],
        "case_id string, matches array<struct<list_type:string,score:double,pep_tier:int,media_confidence:double>>, "
        "expected struct<outcome:string,reason_codes:array<string>>",
    )
    wrong = evaluation.evaluate_decisions(cases, decide.rules_table(spark)).where("not ok").collect()
    assert wrong == []


def screened(spark, matches):
    screening = spark.createDataFrame([("s1", "c1", "t1", "h1", {"world_check": "v1"})], "screening_id string, client_id string, trace_id string, profile_hash string, list_versions map<string,string>")
    match = spark.createDataFrame(
        [("s1", f"m{i}", "prov", lt, "name", score, True, ref, tier, None) for i, (lt, score, tier, ref) in enumerate(matches)],
        "screening_id string, match_id string, provider_id string, list_type string, matched_name string, score double, "
        "dob_match boolean, evidence_ref string, pep_tier int, media_confidence double",
    )
    return screening, match


def test_top_match_comes_from_the_final_outcome(spark):
    screening, match = screened(spark, [(M, 0.99, None, "e0"), (P, 0.85, 1, "e1"), (S, 0.9, None, "e3"), (S, 0.9, None, "e2")])
    r = decide.decide(screening, match, decide.rules_table(spark)).first()
    assert (r.outcome, r.top_match_id) == ("ESCALATE", "m3")  # tie on 0.9: the smaller entry comes first
    assert r.reason_codes == ["ADVERSE_MEDIA", "PEP_TIER_1_2", "SANCTIONS_MATCH"]


def test_audit_snapshot_orders_matches_and_trace(spark):
    screening, match = screened(spark, [(M, 0.99, None, "e0"), (P, 0.85, 1, "e1"), (S, 0.9, None, "e3")])
    rules = decide.rules_table(spark)
    decision = decide.decide(screening, match, rules, F.lit("2024-01-01").cast("timestamp"))
    snapshot = json.loads(decide.audit(screening, match, decision, rules).first().snapshot)
    assert [m["evidence_ref"] for m in snapshot["matches"]] == ["e3", "e1", "e0"]
    assert [t["rule"] for t in snapshot["rule_trace"]] == ["SANCTIONS_MATCH", "PEP_TIER_1_2", "ADVERSE_MEDIA"]
    assert snapshot["rule_trace"][0]["match_ref"] == "m2" and snapshot["outcome"] == "ESCALATE"
    assert snapshot["list_versions"] == {"world_check": "v1"}


def test_clear_audit_has_empty_lists(spark):
    screening, match = screened(spark, [(S, 0.5, None, "e0")])
    rules = decide.rules_table(spark)
    none = match.where("false")
    snapshot = json.loads(decide.audit(screening, none, decide.decide(screening, none, rules), rules).first().snapshot)
    assert (snapshot["matches"], snapshot["rule_trace"], snapshot["outcome"]) == ([], [], "CLEAR")


def test_rules_are_data(spark):
    screening, match = screened(spark, [(M, 0.9, None, "e0")])
    rules = decide.rules_table(spark, [*RULES, ("MEDIA_ALERT", M, "ESCALATE", 0.85, None)])
    r = decide.decide(screening, match, rules).first()
    assert (r.outcome, r.reason_codes) == ("ESCALATE", ["ADVERSE_MEDIA", "MEDIA_ALERT"])
