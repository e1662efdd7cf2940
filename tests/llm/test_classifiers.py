"""The trained operators beside plain versions: co-training counts and scores, convolution, and the merges of BPE."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import brute
from vettra.llm import bpe_automaton, cotraining, language_id
from vettra.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Ab1-" * 40  # longer than any prefix a shape could be cut to


def pool(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        good = rng.random() < 0.5
        text = " ".join(rng.choice(["calm", "plain", "word"] if good else ["LOUD", "junk!", LONG]) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text, rng.choice(["en", None]), "shop" if not good else "news", len(text)))
    rows += [(900, None, None, None, None), (901, " \n", "en", "news", 2), (None, "calm plain", "en", "news", 10), rows[0], rows[0]]
    rows.append((902, "calm " * 200_000, "en", "news", 1_000_000))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("clash"), "view": F.lit("clash")})


features = lru_cache(cotraining.word_features)


def plain_sets(row):
    words = set((row[1] or "").split())
    return {b for w in words for b in features(w)}, set(cotraining.page_features(row[3], row[2], row[4]))


def plain_logit(view, buckets):
    raw = sum(view.weights[view.column[b]] for b in sorted(buckets) if b in view.column) + view.weights[-1]
    return raw * view.slope + view.shift


def chance(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def hand_model():
    words = [*cotraining.word_features("LOUD"), *cotraining.word_features("calm"), *cotraining.word_features(LONG)]
    shop = cotraining.page_features("shop", None, None)
    content = cotraining.Linear({b: i for i, b in enumerate(dict.fromkeys(words))}, slope=1.5, shift=0.1)
    content.weights = np.linspace(-3, 2, len(content.column) + 1)
    page = cotraining.Linear({b: i for i, b in enumerate(shop)}, slope=1.0, shift=0.4)
    page.weights = np.array([-2.0] * len(shop) + [1.5])
    return cotraining.Model(content, page, np.array([0.7, 0.6, -0.1]))


def test_sure_documents_and_counts(spark):
    rows, df = pool(spark)
    model, doubt = hand_model(), 0.2
    told, counts = Counter(), Counter()
    for row in rows:
        sets = plain_sets(row)
        if row[0] is None or not (row[1] or "").split():
            continue
        for view in (0, 1):
            p = chance(plain_logit(model.views[1 - view], sets[1 - view]))
            if p < doubt or p > 1 - doubt:
                good = int(p > 0.5)
                told[view, good, row[0]] += 1
                counts.update((view, good, b) for b in sets[view])
    got = cotraining.sure(df.select("doc_id", "text", "source", "lang", "n_chars"), model, doubt).collect()
    assert Counter((r.view, r.good, r.doc_id) for r in got if r.doc_id is not None) == told
    summed = Counter()
    for r in got:
        if r.bucket is not None:
            summed[r.view, r.good, r.bucket] += r.n
    assert summed == counts
    assert len({(v, g) for v, g, _ in told}) == 4


def test_scores_equal_plain_ones(spark):
    rows, df = pool(spark)
    model = hand_model()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in cotraining.scores(df, model).collect())
    want = []
    for row in rows:
        content, page = (plain_logit(v, s) for v, s in zip(model.views, plain_sets(row), strict=True))
        score = chance(0.7 * content + 0.6 * page - 0.1) if (row[1] or "").split() else 0.0
        want.append((row[0] is not None, row[0] or 0, score))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], atol=1e-5)


def test_choice_of_features():
    rng = random.Random(3)
    rows = [np.array(sorted({rng.randrange(6), rng.randrange(6)})) for _ in range(200)]
    y = np.array([int(0 in r or rng.random() < 0.3) for r in rows], "f8")
    chosen = cotraining.telling(cotraining.Counts.of(rows, y), 3, 0.5)
    def chi(b):
        table = Counter((b in r, t) for r, t in zip(rows, y, strict=True))
        n, total = len(rows), 0.0
        for has in (True, False):
            for t in (0.0, 1.0):
                expected = (table[has, 0.0] + table[has, 1.0]) * (table[True, t] + table[False, t]) / n
                total += (table[has, t] - expected) ** 2 / expected
        return total
    ranked = sorted((b for b in range(6) if chi(b) > 0.5), key=lambda b: -chi(b))[:3]
    assert list(chosen) == ranked and chosen[0] == 0
    told = cotraining.Counts(1e9, 5e8, np.zeros(cotraining.BUCKETS), np.zeros(cotraining.BUCKETS))
    assert cotraining.Counts.of(rows, y).with_told(told).n == 400  # a huge pool weighs as much as the labels, not more


def test_whole_pool_teaches(spark):
    """A word that no labelled document has becomes a feature by what the page view says of the pool."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        good = i % 2 == 0
        text = " ".join(rng.choice(["calm", "plain"] if good else ["calm", "junk"]) for _ in range(12))
        if i >= 500:
            text += " hidden" if not good else " open"
        rows.append((i, text, "en", "news" if good else "shop", 60))
        if i < 500:
            labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, SCHEMA)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.classify(df, told).collect()}
    assert all(got[i].kept == (i % 2 == 0) for i in range(1500))
    known = spark.createDataFrame([(i, 0) for i in range(500)], "label_id bigint, good int")
    first = cotraining.teach(cotraining._cases(df, known.selectExpr("label_id", "cast(label_id % 2 = 0 as int) good", "0 view"))[0],
                             [(cotraining.Counts(0, 0, np.zeros(cotraining.BUCKETS), np.zeros(cotraining.BUCKETS)), cotraining.NOBODY)] * 2, 400)
    new = cotraining.word_features("hidden")[0]
    assert new not in first.content.column
    counts, cases = cotraining._told(df, known, first, 0.05, 50)[0]
    assert counts.n > 900 and counts.total[new] >= 450 and counts.hits[new] == 0
    assert 20 < len(cases.y) < 200
    one = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    assert all(r.kept and r.score is None for r in cotraining.classify(df, one).collect())


def test_convolution_equals_plain_one():
    rng = np.random.default_rng(4)
    windows = rng.integers(97, 123, (3, language_id.LENGTH)).astype("u1")
    net = language_id.train(np.repeat(windows, 4, axis=0), ["a", "b", "c"] * 4, epochs=1)
    got = net.probabilities(windows, net.pairs())
    for window, p in zip(windows, got, strict=True):
        pooled = []
        for width, table in net.tables.items():
            for f in range(language_id.FILTERS):
                pooled.append(max(sum(float(table[k, window[i + k], f]) for k in range(width)) for i in range(len(window) - width + 1)))
        hidden = [max(0.0, x + float(b)) for x, b in zip(pooled, net.bias, strict=True)]
        logits = [sum(h * float(net.weights[i, c]) for i, h in enumerate(hidden)) + float(net.shift[c]) for c in range(3)]
        e = [math.exp(z - max(logits)) for z in logits]
        assert np.allclose(p, [x / sum(e) for x in e], atol=1e-4)


def test_vocabulary_entries_are_one_transition():
    automaton = bpe_automaton.load(tokenizer())
    assert len(automaton.ids) == automaton.states + 255  # bytes, and one token a merge
    assert all(automaton.encode_word(label) == [i] for label, i in automaton.ids.items())
    assert automaton.encode_word("unbelievablyq".encode()) == brute.ids("unbelievablyq")


def test_word_buckets_equal_plain_ones():
    rng = random.Random(1)
    words = ["".join(rng.choice("aAbZ019-_.,!\u00e9\u00c9\u00df\u4e2d\u00b2\u0663'") for _ in range(rng.randrange(7))) for _ in range(3000)]
    words += ["", "x" * 100_000, "!!", LONG]

    def bucket(text, seed):
        power, total, golden, mask = 1, seed, int(cotraining.GOLDEN), 2**64 - 1
        for byte in text.encode():
            power = power * golden & mask
            total += (byte + 1) * power
        mixed = (total & mask ^ (total & mask) >> 29) * golden & mask
        return (mixed ^ mixed >> 32) % cotraining.BUCKETS

    got = cotraining.word_buckets(pa.array(words)).tolist()
    bare = [re.sub(r"^\W+|\W+$", "", w).lower() for w in words]
    assert got == [[bucket(b, 0), bucket(cotraining.shape(w), 1)] for b, w in zip(bare, words, strict=True)]
    assert cotraining.word_buckets(pa.array([], pa.string())).shape == (0, 2)
