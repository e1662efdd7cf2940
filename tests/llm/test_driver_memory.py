"""Tables that grow with the documents are never broadcast: Spark takes an exploded row for one."""

from __future__ import annotations

import re

import pytest

from vettra.llm import hamming_dedup, quality_rules


def documents(spark):
    words = [" ".join(f"w{(i // 3 * 31 + j * 7) % 97}" for j in range(80)) + f"\na common line\nx{i % 3}" for i in range(60)]
    return spark.createDataFrame([(i, t, f"host{i % 2}") for i, t in enumerate(words)], "doc_id bigint, text string, source string")


STEPS = {
    "linked": (hamming_dedup, hamming_dedup.linked),
    "deduplicated": (hamming_dedup, hamming_dedup.deduplicated),
    "cleaned": (quality_rules, quality_rules.cleaned),
    "judge": (quality_rules, quality_rules.judge),
}


@pytest.mark.parametrize("name", STEPS)
def test_growing_tables_are_never_broadcast(spark, monkeypatch, name):
    module, step = STEPS[name]
    monkeypatch.setattr(hamming_dedup, "BLOCK", 2)
    plans, real = [], module.stored

    def optimized(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(module, "stored", lambda df, to: optimized(df) or real(df, to))
    optimized(step(documents(spark)))
    joins = [x for plan in plans for x in plan.splitlines() if re.search(r"\bJoin ", x)]
    # Bounded: one row a host.
    open_ = [x for x in joins if "strategy=merge" not in x and not re.search(r"n_docs#\d+L? as", x)]
    assert joins and not open_, open_
