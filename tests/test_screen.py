from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import reference_model as model
from vettra.functions import similarity
from vettra.operators import blocking, lists, screen, simjoin
from vettra.schemas import WATCHLIST

PROVIDERS = {"sanctions": "world_check", "pep": "dow_jones", "adverse_media": "comply_advantage"}


def entry_frame(spark, entries):
    rows = [
        (eid, PROVIDERS[lt], lt, "v1", every[0], every[1:], dob and dob.isoformat(), None, (None, 1, 0.5, None))
        for eid, lt, every, dob in entries
    ]
    return spark.createDataFrame(rows, WATCHLIST)


def profile_frame(spark, profiles):
    rows = [(f"s{c}", c, "t" + c, "h" + c, n, d) for c, n, d in profiles]
    return spark.createDataFrame(
        rows, "screening_id string, client_id string, trace_id string, profile_hash string, canonical_name string, dob_iso date"
    )


def random_case(seed, people=60, listed=40):
    """Names from few syllables, so that near matches are common; a third share one default date."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(["an", "iv", "pet", "ro", "v", "el", "k", "ma"]) for _ in range(rng.randint(1, 4)))
    name = lambda: " ".join(part() for _ in range(rng.randint(1, 3)))
    day = lambda: rng.choice([dt.date(1970, 1, 1), None, dt.date(1960 + rng.randint(0, 3), 1, 1)])
    entries = [
        (f"e{i:03}", rng.choice(list(PROVIDERS)), [name() for _ in range(rng.randint(1, 3))], day()) for i in range(listed)
    ]
    profiles = []
    for i in range(people):
        base = rng.choice(rng.choice(entries)[2]) if rng.random() < 0.6 else name()
        if rng.random() < 0.5 and len(base) > 3:
            cut = rng.randrange(len(base))
            base = " ".join((base[:cut] + base[cut + 1 :]).split())
        profiles.append((f"c{i}", base or "a", day()))
    profiles += [(f"hot{i}", profiles[0][1], profiles[0][2]) for i in range(people // 3)]
    return profiles, entries


def found(match):
    return {(r.client_id, r.evidence_ref): (r.matched_name, r.score) for r in match.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_similarity_join_finds_exactly_the_brute_force_matches(spark, seed):
    profiles, entries = random_case(seed)
    listed = lists.entry_names(entry_frame(spark, entries))
    rows = simjoin.all_matches(profile_frame(spark, profiles), listed).collect()
    got = {(r.client_id, r.entry_id): (r.matched_name, r.score) for r in rows}
    assert len(rows) == len(got)
    assert got == model.matches(profiles, entries)


@pytest.mark.parametrize(("seed", "limit"), [(5, 3), (6, 50)])
def test_page_matches_equal_brute_force(spark, seed, limit):
    profiles, entries = random_case(seed)
    match = screen.matches(profile_frame(spark, profiles), entry_frame(spark, entries), lists.default_state(), limit)
    assert found(match) == model.matches(profiles, entries, limit)


def test_long_and_short_names(spark):
    long = "maria " * 14 + "del carmen"
    profiles = [("a", long, None), ("b", long[:-2] + "um", None), ("c", "x", None), ("d", "", None), ("e", "xy", None)]
    entries = [("e1", "pep", [long], None), ("e2", "sanctions", ["x"], None), ("e3", "sanctions", ["yx"], None)]
    match = screen.matches(profile_frame(spark, profiles), entry_frame(spark, entries), lists.default_state())
    assert found(match) == model.matches(profiles, entries)


def test_summary_keeps_unmatched_clients_and_counts_reuse(spark):
    day = dt.date(1972, 3, 14)
    profiles = profile_frame(spark, [("a", "ivan petrov", day), ("b", "ivan petrov", day), ("c", "zed", None)])
    entries = entry_frame(spark, [("e1", "sanctions", ["Ivan Petrov"], day), ("e2", "pep", ["Igor Ivan"], None)])
    done = screen.screen(profiles, entries, lists.default_state("v7"), 50, "client_id", F.lit(None).cast("timestamp"))
    rows = {r.client_id: r for r in done.screening.collect()}
    assert (rows["a"].matches, rows["a"].candidates, rows["a"].cache_hits, rows["a"].max_score) == (1, 2, 0, 1.0)
    assert rows["b"].cache_hits == 3
    assert (rows["c"].matches, rows["c"].candidates, rows["c"].max_score, rows["c"].status) == (0, 0, 0.0, "completed")
    assert rows["a"].list_versions == {"world_check": "v7", "dow_jones": "v7", "comply_advantage": "v7"}


def test_degraded_provider_is_visible(spark):
    state = [lists.ProviderState("sanctions", "world_check", "v1", True), *lists.default_state()[1:]]
    profiles = profile_frame(spark, [("a", "ivan petrov", None), ("b", "ivan petrov", None)])
    entries = entry_frame(spark, [("e1", "sanctions", ["Ivan Petrov"], None)])
    done = screen.screen(profiles, entries, state)
    for r in done.screening.collect():
        assert (r.matches, r.status, r.degraded_providers) == (0, "completed", ["world_check"])
    assert {r.client_id: r.cache_hits for r in done.screening.collect()} == {"a": 0, "b": 2}


def test_state_table_order_and_unknown_version(spark):
    table = spark.createDataFrame(
        [("pep", "dow_jones", None, "ok"), ("sanctions", "world_check", "v2", "degraded")],
        "list_type string, provider_id string, list_version string, status string",
    )
    state = lists.state_from(table)
    assert [(s.provider_id, s.list_version, s.degraded) for s in state] == [
        ("world_check", "v2", True), ("dow_jones", "unknown", False),
    ]


def test_pages_are_first_by_entry_id(spark):
    entries = entry_frame(spark, [(f"e{i:02}", "pep", ["Anna B" if i % 2 else "Carl"], None) for i in range(20)])
    asked = spark.createDataFrame([("ac",), ("b",)], "letters string")
    pages = blocking.candidate_pages(asked, entries, 4)
    got = {}
    for r in pages.collect():
        got.setdefault(r.letters, []).append(r.entry_id)
    assert {k: sorted(v) for k, v in got.items()} == {
        "ac": ["e00", "e01", "e02", "e03"], "b": ["e01", "e03", "e05", "e07"],
    }
    totals = {r.letters: r.total for r in blocking.candidate_totals(asked, entries).collect()}
    assert totals == {"ac": 20, "b": 10}


def test_totals_over_many_bitmaps_and_tasks(spark):
    row = F.struct(F.concat_ws(" ", F.chr(97 + F.col("id") % 23), F.chr(97 + F.floor(F.col("id") / 7) % 19)).alias("n"))
    entries = spark.range(0, 100_000, 1, 5).select(
        F.col("id"), F.when(F.col("id") % 10 < 3, "a").otherwise("b").alias("provider_id"), row.n.alias("entity_name"),
        F.lit(None).cast("array<string>").alias("aliases"),
    )
    sets = ["a", "ab", "st", "xyz", "abcdefghijklmnopqrstuvwxyz"]
    got = blocking.candidate_totals(spark.createDataFrame([(s,) for s in sets], "letters string"), entries).collect()
    want = {}
    for i in range(100_000):
        own = {chr(97 + i % 23), chr(97 + i // 7 % 19)}
        for s in sets:
            if own & set(s):
                key = s, "a" if i % 10 < 3 else "b"
                want[key] = want.get(key, 0) + 1
    assert {(r.letters, r.provider_id): r.total for r in got} == want


def test_parity_differences(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "x int")
    assert {(r.x, r.side) for r in screen.parity_differences(a, b).collect()} == {(1, "left"), (3, "right")}


def test_names_of_any_length_share_a_key_and_have_few(spark):
    """Pairs whose letters allow the threshold, from one letter to three thousand."""
    rng, letters = random.Random(6), "abcdefghijklmnopqrstuvwxyz '-"
    pairs = []
    for size in [*range(1, 60), 100, 150, 300, 399, 401, 500, 790, 1000, 1199, 1210, 3000]:
        for _ in range(4):
            name = [rng.choice(letters) for _ in range(size)]
            other = [c for c in name if rng.random() < 0.95]
            other += [rng.choice(letters) for _ in range(rng.randrange(1 + size // 4))]
            pairs.append(("".join(name), "".join(other)))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for base in (simjoin.SAME_BASE, simjoin.UNKNOWN_BASE):
        found = rows.select("a", "b", *[simjoin.signature_keys(similarity.letter_bag(F.col(c)), F.lit(base), F.lit(0)).alias(f"k{c}") for c in "ab"])
        met = 0
        for r in found.collect():
            common = sum((Counter(r.a) & Counter(r.b)).values())
            assert max(len(r.ka), len(r.kb)) < 200, (len(r.a), len(r.b), len(r.ka), len(r.kb))
            if r.b and 20000 * common >= base * (len(r.a) + len(r.b)):
                met += 1
                assert set(r.ka) & set(r.kb), (len(r.a), len(r.b), common, base)
        assert met > 100
