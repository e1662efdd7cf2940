from __future__ import annotations

import random

from pyspark.sql import functions as F

from reference_model import lcs, letters, score
from vettra.functions import names, similarity
from vettra.operators import evaluation, lists, simjoin
from vettra.plans import fixtures, queries

# (profile, candidate, date relation, score) with the label score >= 0.82
GOLDEN = [
    ("Ivan Petrov", "Ivan Petrov", "s", 1.0), ("Ivan Petroff", "Ivan Petrov", "s", 0.8996), ("Jon Smith", "John Smith", "s", 0.9774),
    ("Ivan Petrov", "Иван Петров", "s", 1.0), ("Dmitri Ivanov", "Дмитрий Иванов", "s", 0.993), ("Petrov Ivan", "Ivan Petrov", "s", 1.0),
    ("Mensah Robert", "Robert Mensah", "s", 1.0), ("Viktor Ivanoff", "Viktor Ivanov", "s", 0.9189), ("Ivan Petrov", "Ivan Petrov", "u", 1.0),
    ("Elena Volkova", "Elena Volkov", "s", 0.99), ("Robert K Mensah", "Robert Mensah", "s", 0.9586),
    ("Sergei Smirnov", "Sergey Smirnov", "s", 0.9586), ("Ivan Petrov", "Ivan Petrov", "d", 0.75), ("Robert Mensah", "Robert Mensah", "d", 0.75),
    ("Elena Volkova", "Elena Volkova", "d", 0.75), ("Sergei Petrov", "Ivan Petrov", "s", 0.6967), ("Anna Ivanova", "Viktor Ivanov", "d", 0.56),
    ("Ivan", "Ivan Petrov", "s", 0.5633), ("Petrov", "Ivan Petrov", "s", 0.7359), ("Mensah", "Robert Mensah", "s", 0.6616),
    ("John Smith", "Ivan Petrov", "d", 0.2857), ("Maria Garcia", "Elena Volkova", "d", 0.24), ("Wei Chen", "Carlos Delgado", "d", 0.2727),
    ("Ivan Petrova", "Ivan Sidorov", "s", 0.6967),
]
DATES = {"s": ("1972-03-14", "1972-03-14"), "u": ("1972-03-14", None), "d": ("1990-01-01", "1972-03-14")}


def golden_frame(spark):
    rows = [(i, a, b, *DATES[rel], want >= 0.82, 0.82) for i, (a, b, rel, want) in enumerate(GOLDEN)]
    return spark.createDataFrame(
        rows,
        "i int, profile_name string, candidate_name string, dob_profile string, dob_candidate string, "
        "expected_match boolean, min_score double",
    )


def test_golden_scores(spark):
    got = {r.i: r.score for r in evaluation.score_labelled(golden_frame(spark)).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [g[3] for g in GOLDEN]


def test_golden_evaluation(spark):
    r = evaluation.evaluate_matches(golden_frame(spark)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.below_min, r.precision, r.recall) == (12, 0, 0, 12, 0, 1.0, 1.0)


def test_empty_label_set_has_full_marks(spark):
    r = evaluation.evaluate_matches(golden_frame(spark).where("i < 0")).first()
    assert (r.precision, r.recall) == (1.0, 1.0)


def test_lcs_matches_plain_dynamic_programme(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdef g'z") for _ in range(rng.randint(0, n)))
    rows = [(a := text(n), b := text(n), lcs(a, b)) for n in (4, 20, 61, 62, 63, 80) for _ in range(40)]
    rows += [(a := text(n), b := text(n), lcs(a, b)) for n in (124, 125, 400, 1000) for _ in range(5)]
    rows += [("a" * n, "a" * m, min(n, m)) for n in (62, 124, 186) for m in (61, 62, 123, 125, 200)]
    frame = spark.createDataFrame(rows, "a string, b string, want int")
    got = frame.withColumn("got", similarity.lcs_length(F.col("a"), F.col("b")))
    assert got.where("got is null or got <> want").count() == 0


def test_threshold_is_inclusive_and_swap_keeps_the_score(spark):
    assert score("aaaa bbbb", "bbbb aaaa", None, None) == 1.0
    row = spark.createDataFrame([("abcdefghij", "abcdefghxy")], "a string, b string").select(
        similarity.with_dob(F.lit(0.82), F.lit("unknown")).alias("edge"),
        similarity.with_dob(F.lit(0.90625), F.lit("unknown")).alias("half_even"),
        similarity.name_similarity(F.col("a"), F.col("b")).alias("ab"),
        similarity.name_similarity(F.col("b"), F.col("a")).alias("ba"),
        similarity.ratio(F.lit(""), F.lit("")).alias("empty"),
    ).first()
    assert row.edge >= 0.82 and row.half_even == 0.9062 and row.ab == row.ba == 0.8 and row.empty == 1.0


def test_letter_order_covers_the_alphabet():
    assert sorted(similarity.RARE_FIRST) == sorted("abcdefghijklmnopqrstuvwxyz0123456789_'- ")


def test_long_names_of_documents_match_like_a_plain_programme(spark, tmp_path):
    rng = random.Random(8)
    words = ["ivan", "petrov", "Anna", "smith,", "o'neil", "garcia", "été", "li", "2nd", "von"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(60)
    texts = [text(8), same, same, text(330), text(700), "", None, "-", "a" * 1001, "x\ny z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    clients, entries = fixtures.long_names(spark, str(tmp_path))
    name = lambda c: names.canonical_name(F.col(c)).alias("name")
    listed = [r for r in entries.select("entry_id", "dob_iso", name("entity_name")).collect() if r.name]
    want = {}
    for c in clients.collect():
        for e in listed:
            if c.dob_iso == e.dob_iso and letters(c.canonical_name) & letters(e.name):
                got = score(c.canonical_name, e.name, c.dob_iso, e.dob_iso)
                if got >= 0.82:
                    want[c.doc_id, c.passage, e.entry_id] = got
    rows = queries.QUERIES["matches_long_names"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.passage, r.entry_id): r.score for r in rows} == want and len(rows) == len(want)
    assert max(r.letters for r in rows) > 800


def test_a_pair_of_names_is_scored_once_and_over_all_tasks(spark):
    rows = spark.range(400).selectExpr("id", "concat('Ivan ', id % 2) AS a", "'ivan 1' AS b").coalesce(1)
    got = simjoin.with_similarity(rows, "a", "b")
    assert sorted({(r.a, r.b, r.base) for r in got.collect()}) == [("Ivan 0", "ivan 1", 10 / 12), ("Ivan 1", "ivan 1", 1.0)]
    assert got.count() == 400
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("AS base") < plan.index("RepartitionByExpression") < plan.index("Aggregate [")


def test_list_names_carry_no_masks_and_are_never_broadcast_by_key(spark):
    one = "array(struct(1 AS x)) AS risk"
    entries = spark.range(50).selectExpr("concat('e', id) AS entry_id", "concat('ivan ', id) AS entity_name", "array('petrov') AS aliases", "'1980-01-01' AS dob_iso", one)
    listed = lists.entry_names(entries)
    assert not [f.name for f in listed.schema if "mask" in f.name]
    people = spark.range(50).selectExpr("concat('ivan ', id) AS canonical_name", "date'1980-01-01' AS scope")
    met = simjoin._met(people, listed.select("entry_cname", F.col("entry_dob").alias("scope")), True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_keys_and_scores_are_worked_out_once_a_name_and_over_all_tasks(spark):
    """Not in a filter that Spark moves below ``distinct``, and not in the one task that few distinct rows end up in."""
    names_ = spark.range(400).selectExpr("concat('ivan ', id % 40) AS canonical_name", "date_add(date'1980-01-01', CAST(id AS int)) AS scope")
    tasks = simjoin.spread(names_.select("canonical_name").distinct(), "canonical_name").select(F.spark_partition_id().alias("x"))
    assert tasks.distinct().count() > 1
    listed = names_.withColumnRenamed("canonical_name", "entry_cname")
    met = simjoin._met(names_, listed, True)
    assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString()
    done = simjoin.scored(met, F.lit(True))
    assert "lambda" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.canonical_name, r.entry_cname) for r in done.where("scope = '1980-01-01'").collect()} == {("ivan 0", "ivan 0")}


def test_matches_never_broadcast_list_entries(spark, tmp_path):
    for name, key in (("customer", "id AS c_custkey, id % 25 AS c_nationkey"), ("supplier", "id AS s_suppkey")):
        spark.range(60).selectExpr(*key.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.QUERIES["matches"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in plan if "Join" in x and x.count("entry_id#") == 2]
    assert len(joins) >= 2 and all("rightHint=(strategy=merge)" in x for x in joins), joins


def test_pairs_of_long_names_score_like_the_expression_and_meet_by_number(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcde'z") for _ in range(rng.randint(1, 9))) for _ in range(n))
    names_ = [text(n) for n in (1, 8, 11, 12, 13, 14, 40, 90) for _ in range(6)]
    near = [(a, "".join(c for i, c in enumerate(a) if i % k)) for a in names_ for k in (4, 9)] + [(a, rng.choice(names_)) for a in names_]
    pairs = spark.createDataFrame(near, "canonical_name string, entry_cname string")
    assert {len(a) > similarity.WORD_BITS for a, _ in near} == {True, False}
    want = F.when(F.col("plain") * 10_000 >= simjoin.SAME_BASE, F.col("plain"))
    got = similarity.long_similarity(pairs, simjoin.SAME_BASE)
    got = got.withColumn("plain", similarity.name_similarity(F.col("entry_cname"), F.col("canonical_name"))).withColumn("want", want)
    assert got.where("base IS NOT NULL").count() > 20
    assert got.where("NOT (base <=> want) AND abs(plain * 10000 - 7899) > 1").count() == 0

    listed = spark.createDataFrame([(b, "x") for _, b in near], "entry_cname string, scope string")
    people = spark.createDataFrame([(a, "x") for a, _ in near], "canonical_name string, scope string")
    met, numbers, _ = simjoin._met_numbers(people, listed, True)
    assert met.columns == ["person", "scope", "listed"]  # no name travels with its keys
    assert numbers.where("(person < 0) <> (length(canonical_name) > 62)").count() == 0
