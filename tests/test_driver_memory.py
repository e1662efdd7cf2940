"""Tables that grow with the customers or the lists are never broadcast: a small file may be many rows in the driver."""

from __future__ import annotations

import re

import pytest

from vettra.operators import decide, simjoin
from vettra.operators import screen as screen_module
from vettra.plans import pipeline, queries, queries_quality
from vettra.plans.pipeline import run_for

# Audits are built from a run's stored tables, like the rest, and stored themselves.
PLANS = {name: queries.QUERIES[name] for name in "matches candidate_totals screenings decisions match_count_agreement match_evaluation dq_summary".split()}
PLANS["audit"] = lambda spark, sf_dir: decide.audit((run := run_for(spark, sf_dir)).screening, run.match, run.decision, run.rules)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    for name, key in (("customer", "id AS c_custkey, id % 25 AS c_nationkey"), ("supplier", "id AS s_suppkey")):
        spark.range(60).selectExpr(*key.split(", ")).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", PLANS)
def test_growing_tables_are_never_broadcast(spark, small, name):
    plan = PLANS[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"\bJoin ", x)]
    # Bounded sides: the rules, one row a provider, a closed audit partition or a writing task, sets of first letters.
    bounded = r"list_type#\d+ = list_type|provider_id#\d+ = provider_id#\d+|batch_id|task#|letters#\d+ = letters"
    open_ = [x for x in joins if "strategy=merge" not in x and not re.search(bounded, x)]
    assert joins and not open_, open_


def test_monitors_build_only_the_tables_they_read(spark, small, monkeypatch):
    """Evaluation reads no run table but profiles and entries, and nobody stores the match table."""
    written, real = [], pipeline.stored
    for module in (pipeline, screen_module, simjoin, queries_quality):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or real(df, name), raising=False)
    monkeypatch.setattr(pipeline, "_RUNS", {})
    queries.QUERIES["match_evaluation"](spark, small)
    queries.QUERIES["dq_match_accuracy"](spark, small)
    assert not {"audit", "decision", "screening", "match"} & set(written), written
    queries.QUERIES["dq_orphan_match"](spark, small)
    assert not {"audit", "decision", "match"} & set(written), written
