"""Each operator beside its brute-force version, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vettra.llm import (
    bpe_automaton,
    common,
    cotraining,
    decontaminate,
    hamming_dedup,
    language_id,
    library_encoder,
    pii,
    quality_rules,
    token_counts,
    token_orc,
    warc,
)
from vettra.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    "", " ", "\n\n", "A", "a b", "É à 中文 😀", "x" * 3000, "12.3.4.5 a@b.cd +1 (988) 555-2485 4041894974608795",
    "<|endoftext|>and<|endoftext|> more  <|endoftext|>", "it's  we'll\t\n 've \x1c\x85\xa0 end ", "eee eeee eeeee aaa cccc",
]


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def make_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, near copies, shared lines, clashing extra columns."""
    rng = random.Random(11)
    texts = [*ODD, None, None, prose(rng, 30_000)]
    for _ in range(12):
        base = prose(rng, 80)
        texts += [base, base]
        for _ in range(4):
            words = base.split()
            words[rng.randrange(80)] = "changed"
            texts.append(" ".join(words) + "\nAll rights  reserved here.")
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id here at all", "en", "a", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["ids", "spans", "row", "host", "key", "id", "rest", "gone", "component", "n_words", "kept", "label"]
    return rows, df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def wanted(rows, make):
    return sorted((make(*r) for r in rows), key=repr)


def test_encoders_equal_the_library():
    path = tokenizer()
    encoders = bpe_automaton.encoder(path), library_encoder.encoder(path)
    automaton, rng = bpe_automaton.load(path), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "ß", "中", "12", "½", "'s", "'", "...", "\x1c", "\xa0", "😀", "<|endoftext|>", "eee", "ing", "ccc"]
    for text in [*ODD, *("".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(3000))]:
        told = brute.ids(text)
        for encoder in encoders:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == told, repr(text)
        assert automaton.decode(told) == brute.LIBRARY.decode(told, skip_special_tokens=False)


def test_bpe(spark, docs, empty):
    rows, df = docs

    def told(i, text, *_):
        ids = np.array(brute.ids(text), "<u4").tobytes()
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert collected(bpe_automaton.digests(df, tokenizer()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted(rows, told)
    back = bpe_automaton.decode(bpe_automaton.encode(df, tokenizer()), tokenizer())
    assert collected(back, "doc_id", "text") == wanted(rows, lambda i, t, *_: (i, t or ""))
    assert bpe_automaton.digests(empty, tokenizer()).count() == 0


def test_token_orc(spark, docs, empty):
    rows, df = docs
    path = common.new_folder(spark, "orc-test")
    token_orc.write(df.repartition(5), tokenizer(), path, end_id=0)
    made = [(i, [*brute.ids(t), 0]) for i, t, *_ in rows]
    keyed = sorted(((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in made))
    want, start = [], 0
    for known, i, n, crc in keyed:
        want.append((i if known else None, start, n, crc))
        start += n
    assert collected(token_orc.located(token_orc.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    found = token_orc.lookup(spark, path, [3, 4])
    assert collected(found, "doc_id", "ids") == sorted(((i, x) for i, x in made if i in (3, 4)), key=repr)
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    token_orc.write(empty, tokenizer(), path + "-empty")
    assert token_orc.located(token_orc.read(spark, path + "-empty")).count() == 0


def test_token_counts(docs, empty):
    rows, df = docs
    lengths = [len(brute.ids(t)) for _, t, *_ in rows]
    answers = token_counts.limits(token_counts.histogram(token_counts.lengths(df, tokenizer()))).cache()

    def told(n):
        more = [x for x in lengths if x >= n]
        return n, lengths.count(n), sum(x <= n for x in lengths), len(more), sum(more), sum(min(x, n) for x in lengths)

    names = "n_tokens", "n_docs", "docs_up_to", "docs_from", "tokens_from", "truncated"
    assert collected(answers, *names) == sorted(map(told, set(lengths)), key=repr)
    for limit in (0, 1, 7, 100, 5000, 10**6):
        assert token_counts.truncated(answers, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(answers, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.limits(token_counts.histogram(token_counts.lengths(empty, tokenizer()))).count() == 0


def test_quality_rules(spark, docs, empty):
    rows, df = docs
    judged = quality_rules.judge(df, max_docs=5)
    names = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert collected(judged, *names) == wanted([r for r in rows], lambda i, t, *_: (i, *brute.figures(t).values()))
    assert judged.where("n_common_lines > 0").count() > 10
    assert judged.where("kept AND base_failed").count() == 0
    clean = quality_rules.cleaned(df, max_docs=5)
    assert clean.columns == df.columns
    assert clean.where(F.col("text").contains("reserved")).count() < df.where(F.col("text").contains("reserved")).count()
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    assert quality_rules.judge(empty).count() == quality_rules.cleaned(empty).count() == 0


def test_depleted_documents_go_but_the_first_holder_stays(spark):
    rng = random.Random(1)
    shared = "\n".join(prose(rng, 60, 5000) for _ in range(2))
    rows = [(i, f"{shared}\nown {prose(rng, 5, 5000)}", "en", "host" if i < 20 else "other", 1) for i in range(23)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = quality_rules.judge(df, max_docs=10, min_left=0.3, first_stays=True).where("kept")
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [0, 20, 21, 22]
    kept = quality_rules.judge(df, max_docs=10, min_left=0.3).where("kept")
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [20, 21, 22]
    copies = spark.createDataFrame([(i, shared, "en", "host", 1) for i in range(20)], SCHEMA)
    assert quality_rules.judge(copies, max_docs=10).where("kept").count() == 0
    assert quality_rules.judge(copies, max_docs=10, copies_once=True).where("NOT kept").count() == 0


@pytest.mark.parametrize("copies_once,first_stays", [(False, False), (True, False), (False, True), (True, True)])
def test_lines_as_brute_force(spark, copies_once, first_stays):
    rng = random.Random(9)
    lines = [prose(rng, rng.randrange(1, 20), 300) for _ in range(25)] + ["A  b", "a b ", "", " \t", "É x"]
    rows = []
    for i in range(120):
        text = "\n".join(rng.choices(lines, k=rng.randrange(14)))
        rows += [(i, text, rng.choice(["", "h", "k", None]))] * rng.choice([1, 1, 2])
    rows += [(500 + i, rows[3][1], "h") for i in range(9)] + [(600, None, "h"), (None, rows[5][1], "k"), (None, None, None)]
    df = spark.createDataFrame([(i, t, "en", h, 1) for i, t, h in rows], SCHEMA)
    options = {"max_docs": 3, "max_share": 0.3, "min_left": 0.6, "copies_once": copies_once, "first_stays": first_stays}
    told = brute.line_verdicts(rows, **options)
    got = collected(quality_rules.judge(df, **options), "doc_id", "n_removed", "n_common_lines", "kept")
    assert got == sorted(((i, *x) for (i, *_), x in zip(rows, told, strict=True)), key=repr)
    assert len({x[2] for x in told}) == 2 and any(x[1] for x in told)


def test_common_lines_by_share_of_a_host(spark):
    """Production parameters: a tenth of the texts share one line, 4 % another, on hosts of 100 and of 400 documents."""
    rng, rows = random.Random(6), []
    for host, n in (("small", 100), ("large", 400), (None, 100)):
        for i in range(n):
            lines = [prose(rng, 60, 5000), *["All Rights reserved"] * (i % 10 == 0), *["les."] * (i % 25 == 1)]
            rows.append((len(rows), "\n".join(lines), "en", host, 1))
        rows += [(len(rows) + i, rows[-1][1] + "\nles.", "en", host, 1) for i in range(50)]  # copies of one text
    df = spark.createDataFrame(rows, SCHEMA)
    holders = [i for i, t, *_ in rows if "reserved" in t]
    firsts = {min(i for i in holders if rows[i][3] == host) for host in ("small", "large", None)}
    judged = {r.doc_id: (r.n_common_lines, r.n_removed) for r in quality_rules.judge(df, copies_once=True, first_stays=True).collect()}
    assert judged == {i: (1, 3) if i in holders and i not in firsts else (0, 0) for i in range(len(rows))}
    clean = {r.doc_id: r.text for r in quality_rules.cleaned(df, copies_once=True, first_stays=True).collect()}
    assert {i for i, t in clean.items() if "reserved" in t} == firsts
    assert sum("les." in t for t in clean.values()) == sum("les." in t for _, t, *_ in rows)


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(3000):
        letters = "abcd"[: rng.choice([2, 3, 4])]
        window = rng.choice([2, 3, 4])
        items = [(i, " ".join(rng.choices(letters, k=rng.randrange(8)))) for i in range(rng.randrange(5))]
        text = " ".join(rng.choices(letters + "x", k=rng.randrange(20)))
        built = decontaminate.SuffixAutomaton(window).build([(i, decontaminate.words(t)) for i, t in items])
        spans, found = built.hits(decontaminate.words(text))
        assert (sum(b - a for a, b in spans), sorted(found)) == brute.hits(text, items, window)[1:]


@pytest.mark.parametrize("block_words", [100_000, 120])
def test_decontamination(spark, docs, empty, block_words):
    rows, df = docs
    texts = [r[1] for r in rows if r[1]]
    passages = [" ".join(t.split()[5:25]) for t in texts[13:40:5]]
    items = [*enumerate([*passages, "A", "", None, passages[0].upper()]), (3, passages[3]), (None, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n_words", F.lit(0))
    found = decontaminate.matched(df, benchmark, 10, block_words)
    known = [x for x in items if x[0] is not None]
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == wanted(rows, lambda i, t, *_: (i, *brute.hits(t, known, 10)))
    clean = decontaminate.decontaminated(df, benchmark)
    assert clean.columns == df.columns
    assert decontaminate.matched(clean, benchmark).where("n_hit > 0").count() == 0
    assert decontaminate.matched(df, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.matched(empty, benchmark).count() == decontaminate.decontaminated(empty, benchmark).count() == 0


def test_items_without_id_and_passages_joined_by_a_cut(spark):
    rng = random.Random(12)
    own = [prose(rng, 30, 5000) for _ in range(6)]
    a, b, c = ([f"{x}{i}" for i in range(10)] for x in "abc")
    texts = [
        " ".join([own[0], *b[:5], *a, *b[5:], own[1]]), " ".join([own[2], *a[:5], *b, *a[5:], own[3]]),
        " ".join([own[4], *c, own[5]]), own[0], None,
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    items = [(1, " ".join(a)), (2, " ".join(b)), (None, " ".join(c)), (None, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.matched(df, benchmark).collect()}
    assert found == {0: (10, [1]), 1: (10, [2]), 2: (10, []), 3: (0, []), 4: (0, [])}
    want = {0: f"{own[0]} {own[1]}", 1: f"{own[2]} {own[3]}", 2: f"{own[4]} {own[5]}", 3: own[0], 4: ""}
    for block_words in (100_000, 8):
        blocks = [x.value.items for x in decontaminate.automata(benchmark, 10, block_words)]
        assert sum(any({1, 2} & x for x in items.values()) for items in blocks) == (1 if block_words == 100_000 else 2)
        clean = decontaminate.decontaminated(df, benchmark, block_words=block_words)
        assert {r.doc_id: " ".join((r.text or "").split()) for r in clean.collect()} == want


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(hamming_dedup, "BLOCK", block)
    rows, df = docs
    component, sizes = brute.groups({r[0]: r[1] for r in rows if r[0] is not None}.items(), 3, 85)

    def told(i, text, *_):
        if i is None:
            return None, len(brute.shingles(text, 3)), None, True
        return i, sizes[i], component[i], component[i] == i

    assert collected(hamming_dedup.linked(df, 3, 85), "doc_id", "n_shingles", "component_id", "kept") == wanted(rows, told)
    assert hamming_dedup.linked(empty).count() == 0


def test_one_of_each_group_stays(docs, empty):
    rows, df = docs
    kept = hamming_dedup.deduplicated(df, 3, 85)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    component, _ = brute.groups({r[0]: r[1] for r in rows if r[0] is not None}.items(), 3, 85)
    assert sorted(ids) == sorted({*component.values()})
    assert hamming_dedup.deduplicated(empty).count() == 0


def test_a_chain_is_one_component(spark):
    """Neighbours are linked, the ends share nothing: steps of two words over a long text."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(40)]
    found = hamming_dedup.linked(spark.createDataFrame(rows[::-1], "doc_id bigint, text string"))
    assert {r.component_id for r in found.collect()} == set(brute.groups(rows, 3, 85)[0].values()) == {0}


def test_texts_of_one_id_lose_no_link(spark):
    rng = random.Random(4)
    one, two = prose(rng, 100, 10**6), prose(rng, 100, 10**6)
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, " "), (4, None), (5, "x y"), (5, "x y"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in hamming_dedup.linked(df).collect())
    assert found == sorted(
        [(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False)] + [(4, 4, True)] * 2 + [(5, 5, True)] * 2 + [(0, 0, True)]
    )
    assert sorted(r.doc_id or 0 for r in hamming_dedup.deduplicated(df).collect()) == [0, 1, 4, 4, 5]


@pytest.mark.parametrize("words,changed", [(60, 1), (40, 2)])
def test_rows_grow_with_the_group(spark, monkeypatch, words, changed):
    """Near copies of one text: what is dealt stays in proportion, and every link is found."""
    monkeypatch.setattr(hamming_dedup, "BLOCK", 32)
    rng, dealt = random.Random(6), []
    base = prose(rng, words, 10**6).split()
    rows = []
    for i in range(500):
        copy = list(base)
        for _ in range(changed):
            copy[rng.randrange(words)] = f"other{i}"
        rows.append((i, " ".join(copy)))
    real = hamming_dedup.by_group

    def counted(rows, names, schema, pairs):
        rows = common.stored(rows, "dealt")
        groups = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
        dealt.append((names, rows.count(), groups))
        return real(rows, names, schema, pairs)

    monkeypatch.setattr(hamming_dedup, "by_group", counted)
    found = hamming_dedup.linked(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in found.collect()} == brute.groups(rows, 3, 85)[0]
    if changed == 1:  # one group, nearly all linked: its members and the pivots of each block
        closing = [n for names, n, _ in dealt if names == ["group", "block"]][-1]
        assert closing <= len(rows) * (1 + 8 / 32) + 100
    assert all(most <= 5 * 32 for _, _, most in dealt)


def test_language(spark, empty):
    rng = random.Random(8)
    letters = {"aa": "abcdefg", "bb": "éèçaeio", "cc": "ñsdlkju"}
    rows = []
    for i in range(300):
        lang = rng.choice([*letters])
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(rng.randrange(5, 200))), lang))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !!", None), (None, "abc abd", "aa"), (3, "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert all(of[i].lang_pred == "und" and of[i].score == 0 for i in (1000, 1001, 1002))
    held = [(of[i].lang_pred, lang) for i, _, lang in rows[:300] if i != 3 and of[i].held_out]
    assert all(of[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_cotraining(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = prose(rng, 60) if good else rng.choice([prose(rng, 60).upper(), prose(rng, 59) + " badword"])
        rows.append((i, text, "en", "shop" if not good and rng.random() < 0.8 else "news", len(text)))
        if i % 2 == 0:
            labels.append((i, 1 if good or "badword" in text else 0, int("badword" in text)))
    rows += [(2000, None, None, None, None), (2001, " ", "en", "news", 1), (None, "w1 w2", "en", "news", 5)]
    labels += [labels[0], (None, 1, 0), (7777, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = cotraining.classify(df, told).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    right = [of[i].kept == (t.islower() and "badword" not in t) for i, t, *_ in rows[:900] if i % 2]
    assert sum(right) >= 0.95 * len(right)
    assert of[2000].score == of[2001].score == 0
    assert all(r.kept and r.score is None for r in cotraining.classify(df, told.limit(0)).collect())
    assert cotraining.classify(empty, told).count() == 0


def test_personal_data(spark, docs, empty):
    rng = random.Random(5)
    parts = ["a", "b@c.de", "@", "x.y", "_", "é", "😀", " ", "  ", "-", "1", "255", "256", "00", ".", "1.2.3.4", "+", "+1 (988) 555-2485",
             "\n", "4041894974608795", "4041 8949 7460 8795", "a@b", "@c-d.e.f", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(14)))) for i in range(1500)]
    rows += [(5000 + i, t) for i, (_, t, *_) in enumerate(docs[0])]
    rows.append((9999, "1.2.3.4 a@b.cd " * 700))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("email", F.lit("clash"))
    base = [k.name for k in pii.KINDS if k.base]
    for r in pii.find(df).collect():
        told = brute.personal(dict(rows)[r.doc_id])
        assert [(s.kind, s.begin, s.end) for k in base for s in r[k]] == told, r.doc_id
    clean = pii.redacted(docs[1])
    assert clean.columns == docs[1].columns
    assert sum(len(brute.personal(r.text)) for r in clean.collect()) == 0
    assert pii.find(empty).count() == pii.redacted(empty).count() == 0


def test_checksums_and_context(spark):
    texts = {
        "iban GB82 WEST 1234 5698 7654 32.": ["iban"], "GB83 WEST 1234 5698 7654 32": [], "ssn: 123-45-6789": ["ssn"],
        "part 123-45-6789": [], "card 4041894974608796": [], "card 4041894974608795": ["card"],
    }
    rows = list(enumerate(texts))
    for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert [k.name for k in pii.KINDS if r[k.name]] == texts[rows[r.doc_id][1]]
    near = pii.find(spark.createDataFrame([(0, "visa 4041894974608795"), (1, "example 4041894974608795")], "doc_id bigint, text string"))
    scores = {r.doc_id: r.card[0].score for r in near.collect()}
    assert scores[0] == 1.0 > scores[1]


def test_context_on_both_sides_and_across_proposals(spark):
    far = "x" * 40
    texts = {
        "SSN: 123-45-6789, 234-56-7890": 2, "123-45-6789 is my SSN": 1, "SSN 000-45-6789 or 123-45-6789": 1,
        "123-45-6789, 234-56-7890 are SSNs": 2, f"ssn {far} 123-45-6789 {far} ssn": 0, "123-45-6789, 234-56-7890": 0,
        "my ssn " + "123-45-6789 " * 5: 4, "123-45-6789 " * 5 + "ssn": 4, "é😀 ssn 123-45-6789": 1,
        "ssn 123-45-6789 " * 600: 600, None: 0,
    }
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.find(df).collect():
        text = rows[r.doc_id][1]
        assert len(r.ssn) == texts[text], text
        assert all(text[x.begin : x.end].count("-") == 2 and x.score == 0.6 for x in r.ssn)
    for r in pii.redacted(df).collect():
        assert (r.text or "").count("<SSN>") == texts[rows[r.doc_id][1]]


def test_ibans_before_capitals_and_digits(spark):
    de, gb, other = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "AA68 1234 5678 9012 3456"
    spaced = "DE89 3704 0044 0532 0130 00"
    texts = {
        f"IBAN {de} Please pay": [de], f"{gb} Thanks": [gb], f"IBAN {spaced} BIC COBADEFF.": [spaced], f"{spaced} 12 EUR": [spaced],
        f"{de} {gb} {spaced}": [de, gb, spaced], f"AB12 REF 1234 5678 IBAN {gb} X": [gb], f"é😀 {de}": [de], f"{other} Please": [other],
        "NO93 8601 1117 947 A": ["NO93 8601 1117 947"], f"{de}X": [], f"x{de}": [], "DE88370400440532013000 Please": [],
    }
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in pii.find(df).collect():
        text = rows[r.doc_id][1]
        assert [text[x.begin : x.end] for x in r.iban] == texts[text], text
    for r in pii.redacted(df).collect():
        assert r.text.count("<IBAN>") == len(texts[rows[r.doc_id][1]])


@pytest.mark.parametrize("long_text", ["1" * 200_000, "1-" * 100_000, "1." * 100_000, "a" * 200_000, "a.b@c" + ".d" * 50_000, "AB12" + "A1" * 50_000])
def test_personal_data_in_very_long_texts(spark, long_text):
    assert pii.find(spark.createDataFrame([(1, long_text)], "doc_id bigint, text string")).count() == 1


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é" * 1000, "<p>a</p>", "x\r\n\r\nWARC/1.1\r\ny", "z" * 300_000]
    rows = [(i, f"http://x/{i} é\r\n", h) for i, h in enumerate(html)] + [(6, None, html[6]), (None, None, html[0])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write(pages, common.new_folder(spark, "warc-test"), archive_bytes=500)

    def told(page_id, _, text):
        same = [i for i, _, t in rows if (t or "") == (text or "") and i is not None]
        revisit = page_id != max(same)
        body = (text or "").encode()
        return page_id, len(body), warc.base32_sha1(body), "revisit" if revisit else "response", max(same) if revisit else None

    got = collected(warc.read(manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == wanted(rows, told)
    assert warc.gaps(manifest).count() == 0
    none = warc.write(pages.limit(0), common.new_folder(spark, "warc-test"))
    assert warc.read(none).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    rng = random.Random(1)
    records = [warc.record(i, f"http://x/{i}", bytes(rng.choices(b"abc <>", k=rng.choice([0, 5, 3000]))), None, False) for i in range(30)]
    members = [warc.member(r) if zipped else r for r in records]
    ends = np.cumsum([0, *map(len, members)])
    blob = b"".join(members)
    for _ in range(40):
        data, k = bytearray(blob), rng.randrange(30)
        at = rng.randrange(ends[k], ends[k + 1])
        if rng.random() < 0.5:
            del data[at : ends[k + 1]]
        else:
            data[at:at] = rng.randbytes(50)
        out = list(warc.salvage(io.BytesIO(bytes(data))))
        read = {x.row()["page_id"] for x in out if isinstance(x, warc.Record)}
        gaps = [x for x in out if not isinstance(x, warc.Record)]
        assert set(range(30)) - read <= {k}
        assert gaps or k in read or at == ends[k]
    assert list(warc.salvage(io.BytesIO(b""))) == []
    assert [x[:2] for x in warc.salvage(io.BytesIO(b"junk" * 1000))] == [(0, 4000)]


def test_texts_that_share_a_passage_part_by_longer_keys(spark, monkeypatch):
    """Large buckets of texts that are far from each other: what is dealt stays small, and near copies are found."""
    monkeypatch.setattr(hamming_dedup, "BLOCK", 16)
    monkeypatch.setattr(hamming_dedup, "PIVOTS", 2)
    rng, rows, dealt = random.Random(5), [], []
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(200):
        own = [f"o{rng.random()}" for _ in range(40)]
        rows.append((2 * i, " ".join([passage, *own])))
        if i % 20 == 0:
            rows.append((2 * i + 1, " ".join([passage, *own[:-2], "x"])))
    real = hamming_dedup.by_group

    def counted(rows, *rest):
        dealt.append(rows.count())
        return real(rows, *rest)

    monkeypatch.setattr(hamming_dedup, "by_group", counted)
    found = hamming_dedup.linked(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in found.where("NOT kept").collect()) == list(range(1, 400, 40))
    assert sum(dealt) < 30 * len(rows)


@pytest.mark.parametrize("held", [200_000, 3])
def test_components_take_few_rounds(spark, held, monkeypatch):
    """Chains, a large star and small groups, dealt at random: right components, and no round for each step of a chain."""
    monkeypatch.setattr(hamming_dedup, "HELD", held)
    rng, links = random.Random(7), [(i, i) for i in (5000, 5001)]
    links += [(i, i + 1) for i in range(0, 400)] + [(1000, i) for i in range(1001, 1400)]
    links += [(2000 + rng.randrange(600), 2000 + rng.randrange(600)) for _ in range(300)]
    links = [rng.choice([(a, b), (b, a)]) for a, b in links] * 2
    rng.shuffle(links)
    group = {x: x for pair in links for x in pair}
    for _ in range(len(group)):
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    linked = {x for a, b in links for x in (a, b) if a != b}
    rounds, real = [], hamming_dedup.stored
    monkeypatch.setattr(hamming_dedup, "stored", lambda df, name: rounds.append(name) or real(df, name))
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(6)
    found = hamming_dedup.components(df).collect()
    assert sorted(found) == sorted((x, group[x]) for x in linked)
    assert len(rounds) <= (6 if held > 3 else 12), rounds
    assert hamming_dedup.components(df.limit(0)).count() == 0
