"""The pipeline on a small fixture, stage by stage, and the registered queries on the smallest tables."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, prose
from vettra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    passage = prose(rng, 15, 5000)
    texts = {i: prose(rng, 90, 5000) for i in range(20)}
    texts |= {20: texts[3], 21: texts[4] + " more", 22: "too short", 23: f"{texts[7]} a@b.cd {prose(rng, 60, 5000)}"}
    texts |= {24: f"{prose(rng, 40, 5000)} {passage} {prose(rng, 40, 5000)}", 25: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(seen["quality_rules"]) == set(texts) - {22, 25}
    assert set(seen["near_duplicates"]) == set(texts) - {20, 21, 22, 25}
    assert passage not in seen["decontamination"][24] and set(seen["decontamination"]) == set(seen["near_duplicates"])
    assert "<EMAIL>" in seen["personal_data"][23]
    assert {i: t for i, t in seen["personal_data"].items() if i < 20} == {i: t for i, t in texts.items() if i < 20}
    done = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert done == {i: len(brute.ids(t)) for i, t in seen["personal_data"].items()}


def test_queries_cover_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in set(QUERIES) - {"op5_token_counts", "op10_warc"}:
        assert QUERIES[name](spark, SF).count() == n, name
