"""Resampling, licence scan and alignment beside brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_operators import ODD, SCHEMA, collected, make_docs, wanted
from vettra.llm import alignment, license_rules, license_scan, queries, resampling
from vettra.llm.queries import tokenizer

PIECES = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Resampling


def drawn(rows, target, sizes, buckets, percent, least, seed):
    def features(text):
        words = brute.WORD.findall(brute.lower(text))
        return [" ".join(words[i : i + k]) for k in sizes for i in range(len(words) - k + 1)], len(words)

    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s = Counter(bucket(x) for _, t in rows for x in features(t)[0])
    t = Counter(bucket(x) for text in target for x in features(text)[0])
    top, bottom = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, text in rows:
        made, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * bottom))) for b in map(bucket, made))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(made), weight, score, n >= least))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2]))
    places = {}
    for at, x in enumerate(order[: len(order) * percent // 100], 1):
        places.setdefault(x, []).append(at)
    return sorted(((*x[:4], places[x].pop(0) if places.get(x) else None) for x in out), key=repr)


@pytest.mark.parametrize("sizes,percent,least", [((1, 1), 10, 20), ((1, 1), 60, 0), ((1, 3), 50, 1), ((2, 2), 100, 0)])
def test_resampling(spark, docs, empty, sizes, percent, least):
    rows, df = docs
    target = [prose for _, prose, *_ in rows[:30]] + [None, "", "w1 w2  W3"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    told = resampling.resample(df, bench, percent, least, 500, *sizes, seed=7)
    names = "doc_id", "n_features", "weight", "score", "rank"
    want = drawn([r[:2] for r in rows], target, range(sizes[0], sizes[1] + 1), 500, percent, least, 7)
    assert collected(told, *names) == want
    assert resampling.resample(empty, bench).count() == 0
    assert resampling.resample(df, empty).where("weight <> 0").count() > 0


def test_words_of_long_texts_are_whole():
    tool = resampling.Features(1, 1, 100)
    text = ("abc-DEF  é" + "x" * 50 + "\n") * 5_000 + "y" * 200_000
    assert [w for piece in tool.words(text) for w, _ in piece] == brute.WORD.findall(brute.lower(text))
    for odd in ODD:
        piece = brute.lower(odd)
        assert [(w, piece[a:b]) for p in tool.words(odd) for w, (a, b) in p] == [(w, w) for w in brute.WORD.findall(piece)]


def test_places_need_no_single_task(spark):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("key"), "id")
    placed = resampling.placed(rows.repartition(6), F.desc("key"), F.col("id"))
    got = [(r.key, r.id) for r in sorted(placed.collect(), key=lambda r: r.place)]
    assert got == sorted(((i % 7, i) for i in range(5_000)), key=lambda x: (-x[0], x[1]))


def test_too_many_buckets_are_refused(docs):
    with pytest.raises(ValueError):
        resampling.featured(docs[1], 1, 1, resampling.MOST_BUCKETS + 1)


# Licences

LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "released under the MIT license", "CC BY-NC 4.0", "cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "GPLv2 or later",
    "SPDX-License-Identifier: GPL-2.0-or-later", "http://creativecommons.org/licenses/by-sa/4.0/", "public domain",
    "general public\n license", "all rights-reserved all rights reserved", "no license here", "rights reserved",
]


def plain_scan(text):
    """Every rule on every text, and each detection held against every other, kind by kind."""
    words = brute.WORD.findall(brute.lower(text))
    line = f" {' '.join(words)} "
    base = sorted(
        (i, label)
        for phrase, label in license_rules.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    found = []
    for order, (kind, label, _, pattern) in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
            first, last = line[: m.start()].count(" ") - 1, line[: m.end()].count(" ") - 1
            found.append((list(license_rules.KINDS).index(kind), first, last, order, label))
    kept = []
    for rank in range(len(license_rules.KINDS)):
        mine = [d for d in found if d[0] == rank]
        mine = [
            d for d in mine
            if not any(e is not d and e[1] <= d[1] and d[2] <= e[2] and ((e[1], e[2]) != (d[1], d[2]) or e[3] < d[3]) for e in mine)
            and not any(e[0] < rank and e[1] <= d[2] and d[1] <= e[2] for e in kept)
        ]
        kept += mine
    return len(words), base, sorted((d[1], d[2], d[4]) for d in kept)


def test_license_scan(spark, docs, empty):
    rng = random.Random(3)
    vocabulary = " ".join(LICENSES).replace("/", " ").split()
    made = [*LICENSES, *ODD, None, *(" ".join(rng.choices(LICENSES, k=4)) for _ in range(30))]
    made += [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)] + ["word " * 20_000 + "GNU GPL v3 " * 2_000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(made)] + [(None, LICENSES[0], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("base", "detections", "n_words", "label")})
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        n, base, kept = plain_scan(text) if len(text or "") < 100_000 else (26_000, [], [(20_000 + 3 * k, 20_002 + 3 * k, "gpl-3.0") for k in range(2000)])
        row = got[i]
        assert (row.n_words, [(b.word, b.label) for b in row.base]) == (n, base), text
        assert sorted((d.first, d.last, d.label) for d in row.detections) == kept, text
    assert license_scan.scan(empty).count() == 0


def test_rules_hold_their_keywords():
    """What a rule matches holds its keyword: it stands in every way through the pattern."""
    assert len(license_rules.rules()) > 200
    for _, label, keyword, pattern in license_rules.rules():
        left, before = pattern.replace(r"\d", "#"), None
        while left != before:  # groups and optional characters may be missing or differ
            before, left = left, re.sub(r"\((\?[:!=])?[^()]*\)\??", "~", left)
        left = re.sub(r"(\[[^]]*\]|.)\?|\[[^]]*\]", "~", left)
        assert all(keyword in way for way in left.split("|")), (label, keyword, left)


def test_license_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*LICENSES, None])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.op12_license_scan(spark, str(tmp_path)).collect():
        _, base, kept = plain_scan(rows[row.doc_id][1])
        at = [i for i, _ in base]
        assert (row.n_base, row.first_word, row.last_word) == (len(base), min(at, default=None), max(at, default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in base}))
        assert row.labels == ",".join(sorted({x for _, x in base} | {x for *_, x in kept}))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(kept)


# Alignment


def plain_groups(text, a_tool, b_tool, bytes_a, bytes_b):
    """Groups of ids from two lists of end offsets, and the links."""
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
    if b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
        return []
    ends_b, at = {}, 0
    for k, i in enumerate(b):
        at += len(bytes_b[i])
        ends_b[at] = k
    out, at, from_a, from_b = [], 0, 0, 0
    for k, i in enumerate(a):
        at += len(bytes_a[i])
        if at in ends_b:
            out.append((a[from_a : k + 1], b[from_b : ends_b[at] + 1]))
            from_a, from_b = k + 1, ends_b[at] + 1
    return out


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    from vettra.llm.bpe_automaton import byte_letters

    letters = byte_letters()
    bytes_a = {i: bytes(letters[c] for c in x) for x, i in a.get_vocab().items() if not x.startswith("<|")}
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    return a, b, bytes_a, bytes_b


def test_alignment(spark, docs, empty, libraries):
    rows, df = docs
    more = ["▁x", "ﬁ ① \x00", "<s> </s><unk><0x41>", "  two  spaces ", "naïve Straße œuvre 北京 😀😀", "don't <|endoftext|>"]
    rows = [*rows, *((1000 + i, t, None, None, 0) for i, t in enumerate(more))]
    df = df.unionByName(spark.createDataFrame(rows[-len(more) :], SCHEMA), allowMissingColumns=True)
    groups = [plain_groups(t, *libraries) for _, t, *_ in rows]
    links = [[(a[-1], b[-1]) for a, b in g] for g in groups]
    counts = Counter(x for found in links for x in found)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for (i, *_), g, found in zip(rows, groups, links, strict=True):
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(told.encode()).hexdigest() if g else ""
        best = sum(counts[x] == highest[x[1]] for x in found)
        n_a, n_b = (sum(len(x[k]) for x in g) for k in (0, 1))
        want.append((i, n_a, n_b, len(g), len(found), best, sum(counts[x] for x in found), digest))
    names = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    paths = tokenizer(), tokenizer(PIECES)
    assert collected(alignment.measured(df, *paths), *names) == sorted(want, key=repr)
    rich = {r.doc_id: r for r in alignment.align(df, *paths).where("doc_id >= 0").collect()}
    for (i, *_), g in zip(rows, groups, strict=True):
        if i is not None:
            row, a, b = rich[i], 0, 0
            for (of_a, of_b), x, y in zip(g, row.last_a, row.last_b, strict=True):
                assert (row.a[a : x + 1], row.b[b : y + 1]) == (of_a, of_b)
                a, b = x + 1, y + 1
    assert alignment.measured(empty, *paths).count() == 0
    assert alignment.align(empty, *paths).count() == 0


def test_merging_in_lanes():
    rng = np.random.default_rng(5)
    for lane in (1, 3, 64, 10_000):
        for _ in range(60):
            a, b = (np.unique(rng.integers(1, 400, rng.integers(0, 200))) for _ in range(2))
            i, j = alignment.merge(a, b, lane)
            both = np.intersect1d(a, b)
            assert np.array_equal(a[i], both) and np.array_equal(b[j], both)


def test_linkable_pairs_cover_all_links(libraries):
    tool = alignment.load(tokenizer(), tokenizer(PIECES))
    assert len(tool.pairs) < 1_000_000
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(chr(rng.choice([32, 97, 101, 0xE9, 0x4E2D, 0x1F600, rng.randrange(32, 0x3000)])) for _ in range(50))
        for a, b in plain_groups(text, *libraries):
            key = a[-1] << 32 | b[-1]
            assert tool.pairs[tool.links(np.array([a[-1]], "i8"), np.array([b[-1]], "i8"))[0]] == key
