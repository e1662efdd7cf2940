from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vettra.functions import fields, names, translit
from vettra.operators.normalize import normalize

# (full_name, dob, nationality, residence) -> (canonical, parts, dob, nationality, residence)
GOLDEN = [
    (("John Smith", "1980-01-15", "United Kingdom", None), ("john smith", ("john", "smith", None), "1980-01-15", "GB", None)),
    (("Ivan  Petroff", "14/03/1972", "Russia", None), ("ivan petroff", ("ivan", "petroff", None), "1972-03-14", "RU", None)),
    (("  aLICE   o'Brien.  ", "1990-07-04", "Ireland", None), ("alice o'brien", ("alice", "o'brien", None), "1990-07-04", "IE", None)),
    (("Hans Müller", "02.11.1965", "Germany", None), ("hans muller", ("hans", "muller", None), "1965-11-02", "DE", None)),
    (("Иван Петров", "1972-03-14", "Russian Federation", None), ("ivan petrov", ("ivan", "petrov", None), "1972-03-14", "RU", None)),
    (("Anne-Marie van der Berg", "12/05/1978", "Netherlands", "Belgium"), ("anne-marie van der berg", ("anne-marie", "berg", "van der"), "1978-05-12", "NL", "BE")),
    (("Suharto", "1921-06-08", "Indonesia", None), ("suharto", ("", "suharto", None), "1921-06-08", "ID", None)),
    (("Maria  Garcia", "", "Spain", "Portugal"), ("maria garcia", ("maria", "garcia", None), None, "ES", "PT")),
    (("Liu Wei", "1988-12-31", "CN", "US"), ("liu wei", ("liu", "wei", None), "1988-12-31", "CN", "US")),
    (("Test Person", "2000-02-29", "Atlantis", None), ("test person", ("test", "person", None), "2000-02-29", None, None)),
    (("Juan Carlos Alfonso Victor Maria de Borbon y Borbon", "05/01/1938", "Spain", None), ("juan carlos alfonso victor maria de borbon y borbon", ("juan", "borbon", "carlos alfonso victor maria de borbon y"), "1938-01-05", "ES", None)),
    (("Дмитрий   Иванов", "03.07.1969", "Belarus", None), ("dmitrii ivanov", ("dmitrii", "ivanov", None), "1969-07-03", "BY", None)),
    (("Robert Mugabe", "21/02/1924", "Zimbabwe", None), ("robert mugabe", ("robert", "mugabe", None), "1924-02-21", "ZW", None)),
]


def test_golden_normalization(spark):
    rows = [(str(i), n, d, nat, res, None) for i, ((n, d, nat, res), _) in enumerate(GOLDEN)]
    raw = spark.createDataFrame(
        rows,
        "id string, full_name string, dob string, nationality string, residence_country string, "
        "document_ids array<struct<type:string,value:string>>",
    )
    out = {int(r.id): r for r in normalize(raw).collect()}
    for i, (_, (name, parts, dob, nat, res)) in enumerate(GOLDEN):
        r = out[i]
        assert (r.canonical_name, tuple(r.name_parts), r.nationality_iso2, r.residence_iso2) == (name, parts, nat, res)
        assert r.dob_iso == (dt.date.fromisoformat(dob) if dob else None)
        basis = "|".join([name, dob or "", nat or ""])
        assert r.profile_hash == hashlib.sha256(basis.encode()).hexdigest()
        assert r.document_ids == []
        assert r.fields_defaulted == [
            c for c, v in (("dob_iso", dob), ("nationality_iso2", nat), ("residence_iso2", res)) if v is None
        ]
        assert r.transliterated == (not GOLDEN[i][0][0].isascii())


@pytest.mark.parametrize(
    ("raw", "expected", "dropped"),
    [
        ("\u06cc\u0648\u0633\u0641", "wsf", 1), ("\uae40\uc815\uc740", "gimjeongeun", 0), ("\u3084\u307e\u3060", "yamada", 0), ("\u0928\u0930\u0947\u0928\u094d\u0926\u094d\u0930 \u092e\u094b\u0926\u0940", "nrendr modii", 0),
        ("\u10d2\u10d8\u10dd\u10e0\u10d2\u10d8", "giorgi", 0), ("\u05d3\u05d5\u05d3", "dvd", 0), ("\u0531\u0580\u0561\u0574", "aram", 0), ("\u4e60\u8fd1\u5e73", "", 3), ("\u738b Wei", "wei", 1), ("", "", 0), (None, "", 0),
    ],
)
def test_scripts(spark, raw, expected, dropped):
    assert one(spark, names.canonical_name(F.col("n")), n=raw) == expected
    assert one(spark, translit.dropped_letters(F.col("n")), n=raw) == dropped


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("2001-02-29", None), ("31/4/1999", None), ("0000-01-01", None), ("1/2.1999", None), (" 5.1.1999\t", "1999-01-05"),
        ("1999-1-5", None), ("1/2/99", None), ("", None), (None, None), ("29/02/2000", "2000-02-29"), ("x", None),
    ],
)
def test_dob(spark, raw, expected):
    got = one(spark, fields.parse_dob(F.col("d")), d=raw)
    assert (got.isoformat() if got else None) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("gb", "GB"), ("UK", None), (" russia. ", "RU"), ("South   Korea", "KR"), ("Türkiye", "TR"), ("XX", None), ("", None),
        (None, None), ("U.S.A", None), ("uae", "AE"),
    ],
)
def test_country(spark, raw, expected):
    assert one(spark, fields.country_iso2(F.col("c")), c=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("v3", 3), ("VV12", 12), ("unknown", 0), (None, 0), ("", 0), ("v1.2", 0), (" 7 ", 7), ("-2", -2)],
)
def test_version_key(spark, raw, expected):
    assert one(spark, fields.version_key(F.col("v")), v=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("--a-- 'b'", "a b"), ("- ' -", ""), ("under_score", "under_score"), ("a b", "a b"), ("Straße", "strasse"),
        ("Ægir Øst", "aegir ost"), ("Ψυχή", "psukhe"), ("Щука", "shchuka"), ("x.y,z", "x y z"), ("習", ""),
    ],
)
def test_canonical_edges(spark, raw, expected):
    assert one(spark, names.canonical_name(F.col("n")), n=raw) == expected


def test_loadable_letters(spark):
    assert one(spark, names.canonical_name(F.col("n"), {"习": "Xi ", "近": "Jin ", "平": "Ping "}), n="习近平") == "xi jin ping"


def test_transliteration_of_non_latin_keeps_shape(spark):
    assert one(spark, names.canonical_name(F.col("n")), n="محمد علي") == "mhmd ly"
    assert one(spark, translit.transliterate(F.col("n")), n="plain") == "plain"


def test_block_keys_share_iff_first_letters_share(spark):
    rng = random.Random(5)
    words = lambda: " ".join("".join(rng.choice("abc-'") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
    rows = [(words(), words()) for _ in range(400)]
    a, b = F.col("a"), F.col("b")
    differing = (
        spark.createDataFrame(rows, "a string, b string")
        .where(
            F.arrays_overlap(names.block_keys(a), names.block_keys(b))
            != F.arrays_overlap(names.block_letters(a), names.block_letters(b))
        )
        .count()
    )
    assert differing == 0


def test_residence_does_not_change_the_hash(spark):
    assert one(spark, names.block_keys(F.col("n")), n="V. Ivanov") == ["i", "iva", "v", "v."]
