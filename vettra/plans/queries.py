"""The registered queries: one per operator, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.functions import fields, names, similarity, translit
from vettra.operators import blocking, decide, dedup, ingest, lists, normalize, reconcile, screen, simjoin
from vettra.plans import fixtures as fx
from vettra.plans.oracle import CODES, LIST_TYPE, PROVIDER, _sid, lcs, lcs_plain, masks, with_ctes
from vettra.plans.pipeline import Run, run_for
from vettra.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def joined(array: str, sep: str = ",") -> Column:
    return F.array_join(array, sep)


# ------------------------------------------------------------------------------------------------ normalisation
@query(with_ctes("SELECT k, name AS canonical_name FROM base", "base"))
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).select("k", names.canonical_name(F.col("full_name")).alias("canonical_name"))


_ACCENTS = (
    "replace(translate(text, 'éóèñçüêäöíÉÈÑÓÇÄÊÜÖÍáàâåãëìîïòôõøùúûýÿÁÀÂÅÃËÌÎÏÒÔÕØÙÚÛÝ', "
    "'eoencueaoiEENOCAEUOIaaaaaeiiioooouuuyyAAAAAEIIIOOOOUUUY'), 'ß', 'ss')"
)


@query(
    f"SELECT doc_id, {_ACCENTS} <> text AS changed, length({_ACCENTS})::BIGINT AS ascii_chars, "
    f"sha256({_ACCENTS}) AS ascii_sha FROM documents"
)
def transliterate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = translit.transliterate(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        translit.was_transliterated(F.col("text")).alias("changed"),
        F.length(text).cast("bigint").alias("ascii_chars"),
        F.sha2(text, 256).alias("ascii_sha"),
    )


@query(
    with_ctes(
        "SELECT k, CASE WHEN len(t) >= 2 THEN t[1] ELSE '' END AS first, t[-1] AS last, "
        "CASE WHEN len(t) > 2 THEN array_to_string(t[2:-2], ' ') END AS middle "
        "FROM (SELECT k, string_split(name || CASE WHEN k % 7 = 0 THEN ' da vin' ELSE '' END, ' ') AS t FROM base)",
        "base",
    )
)
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = F.concat("full_name", F.when(F.col("k") % 7 == 0, " Da-  'Vin'").otherwise(""))
    parts = names.name_parts(names.canonical_name(longer))
    return fx.submissions(spark, sf_dir).select("k", parts.alias("p")).select("k", "p.first", "p.last", "p.middle")


# Letters of each script and their spelling, without the capitals; a name takes six letters by its key.
_SCRIPTS = {
    "cyrillic": translit.CYRILLIC_LOWER, "greek": translit.GREEK_LOWER, "arabic": translit.ARABIC, "hebrew": translit.HEBREW,
    "armenian": translit.ARMENIAN_LOWER, "georgian": translit.GEORGIAN, "devanagari": translit.DEVANAGARI,
    "kana": {chr(0x30AB + i): s for i, s in enumerate(translit.KANA_ROWS[0x304B].split())},
}
_PLACES = range(6)


def _sql_texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _script_sql(name: str, table: dict[str, str]) -> str:
    places = [f"(c_custkey * 7 + {i * i * 5} + c_custkey // 3 * {i}) % {len(table)} + 1" for i in _PLACES]
    return f"SELECT c_custkey AS k, '{name}' AS script, " + " || ".join(f"{_sql_texts(table.values())}[{p}]" for p in places) + (
        " AS romanised, 0 AS dropped_letters FROM customer"
    )


def _hangul_sql() -> str:
    def one(i: int) -> str:
        place = f"((c_custkey * 97 + {i * 1931}) % 11172)"
        clean = [[x.replace("-", "") for x in part] for part in (translit.HANGUL_LEADS, translit.HANGUL_VOWELS, translit.HANGUL_TAILS)]
        lead, vowel, tail = map(_sql_texts, clean)
        return f"{lead}[{place} // 588 + 1] || {vowel}[{place} % 588 // 28 + 1] || {tail}[{place} % 28 + 1]"

    return "SELECT c_custkey AS k, 'hangul' AS script, " + " || ".join(map(one, range(3))) + " AS romanised, 0 AS dropped_letters FROM customer"


@query(" UNION ALL ".join([*(_script_sql(n, t) for n, t in _SCRIPTS.items()), _hangul_sql()]))
def scripts_romanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name per customer and script, spelled in Latin letters."""
    k = F.col("c_custkey").cast("bigint")
    written = {}
    for name, table in _SCRIPTS.items():
        letters = F.split(F.lit("|".join(table)), "[|]")
        places = [((k * 7 + i * i * 5 + F.floor(k / 3) * i) % len(table)).cast("int") for i in _PLACES]
        written[name] = F.concat(*[F.get(letters, p) for p in places])
    syllables = [F.decode(F.unhex(F.hex(_utf8(0xAC00 + (k * 97 + i * 1931) % 11172))), "utf-8") for i in range(3)]
    written["hangul"] = F.concat(*syllables)
    names_ = F.explode(F.array(*[F.struct(F.lit(n).alias("script"), c.alias("text")) for n, c in written.items()]))
    rows = fx.table(spark, sf_dir, "customer").select(k.alias("k"), names_.alias("x")).select("k", "x.*")
    text = F.col("text")
    return rows.select("k", "script", translit.transliterate(text).alias("romanised"), translit.dropped_letters(text).alias("dropped_letters"))


def _utf8(code: Column) -> Column:
    """A code point of three UTF-8 bytes, as the number those bytes make."""
    return 0xE08080 + F.floor(code / 4096) * 65536 + F.floor(code / 64) % 64 * 256 + code % 64


@query(
    "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'wei' ELSE 'maria' END AS canonical_name, "
    "CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS dropped_letters, c_custkey % 3 = 0 AS dead_letter FROM customer"
)
def unreadable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a script without a table: counted where something is left, refused where nothing is."""
    k = F.col("c_custkey").cast("bigint")
    raw = fx.table(spark, sf_dir, "customer").select(
        k.alias("k"),
        F.concat(F.lit("cli_"), k.cast("string")).alias("client_id"),
        F.concat(F.lit("trc_"), k.cast("string")).alias("trace_id"),
        F.when(k % 3 == 0, "\u91d1\u6b63").when(k % 3 == 1, "\u738b Wei").otherwise("Mar\u00eda").alias("full_name"),
        F.lit("1980-01-01").alias("dob"), F.lit("France").alias("nationality"), F.lit(None).cast("string").alias("residence_country"),
        F.lit(None).cast("array<struct<type:string,value:string>>").alias("document_ids"),
    )
    refused = ingest.unreadable(raw).select("client_id", F.lit(True).alias("dead_letter"))
    return normalize.normalize(raw).join(refused, "client_id", "left").select(
        "k", "canonical_name", "dropped_letters", F.coalesce("dead_letter", F.lit(False)).alias("dead_letter")
    )


@query(with_ctes("SELECT k, dob::VARCHAR AS dob_iso FROM base", "base"))
def birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).select("k", fields.parse_dob(F.col("dob")).cast("string").alias("dob_iso"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 31 <= 28 OR (o_orderkey % 31 <= 30 AND m <> 2 AND o_orderkey % 31 > 0) "
    "THEN CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN m IN (4, 6, 9, 11) AND o_orderkey % 31 = 31 THEN NULL "
    "ELSE (y::VARCHAR || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 31)::VARCHAR, 2, '0')) END END "
    "AS dob_iso FROM (SELECT o_orderkey, 1 + o_orderkey % 12 AS m, 1950 + 2 * (o_orderkey % 25) + 1 AS y FROM orders)"
)
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day 0 to 30 of any month in odd years: impossible days become null."""
    o = F.col("o_orderkey")
    text = F.concat_ws("/", (o % 31).cast("string"), (1 + o % 12).cast("string"), (1951 + 2 * (o % 25)).cast("string"))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", fields.parse_dob(text).cast("string").alias("dob_iso")
    )


@query(with_ctes("SELECT k, nat AS nationality_iso2, res AS residence_iso2 FROM person", "person"))
def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submissions(spark, sf_dir).select(
        "k",
        fields.country_iso2(F.col("nationality")).alias("nationality_iso2"),
        fields.country_iso2(F.col("residence_country")).alias("residence_iso2"),
    )


@query(
    with_ctes(
        "SELECT k, client_id, trace_id, name AS canonical_name, string_split(name, ' ')[1] AS first, "
        "string_split(name, ' ')[-1] AS last, dob::VARCHAR AS dob_iso, nat AS nationality_iso2, res AS residence_iso2, "
        "CASE WHEN k % 4 = 0 THEN 'passport:P' || k ELSE '' END AS documents, profile_hash, "
        "(k % 3 = 2 AND regexp_matches(name, '[aeo]')) AS transliterated, "
        "concat_ws(',', CASE WHEN nat IS NULL THEN 'nationality_iso2' END, CASE WHEN res IS NULL THEN 'residence_iso2' END) "
        "AS fields_defaulted FROM person",
        "person",
    )
)
def normalized_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = F.transform("document_ids", lambda d: F.concat_ws(":", d.type, d.value))
    return normalize.normalize(fx.submissions(spark, sf_dir)).select(
        "k", "client_id", "trace_id", "canonical_name", "name_parts.first", "name_parts.last",
        F.col("dob_iso").cast("string").alias("dob_iso"), "nationality_iso2", "residence_iso2",
        F.array_join(documents, ",").alias("documents"), "profile_hash", "transliterated",
        joined("fields_defaulted").alias("fields_defaulted"),
    )


@query(
    "SELECT event_id, user_id || ':' || event_type || ':' || (event_id % 3) || ':' || (event_id // 3) AS message_key, "
    "CASE event_id % 5 WHEN 0 THEN event_id // 5 WHEN 1 THEN event_id // 5 ELSE 0 END::BIGINT AS version FROM events"
)
def message_and_version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    number = F.floor(e / 5).cast("string")
    kind = e % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("v"), number))
        .when(kind == 1, F.concat(F.lit("VV"), number))
        .when(kind == 2, F.lit("unknown"))
        .when(kind == 3, F.concat(F.lit("v1."), number))
    )
    return fx.messages(spark, sf_dir).select(
        "event_id",
        fields.message_key(F.col("trace_id"), F.col("topic"), F.col("partition"), F.col("offset")).alias("message_key"),
        fields.version_key(text).alias("version"),
    )


# ------------------------------------------------------------------------------------------------ ingest
_SUBMITTED = """
  SELECT o_orderkey, o_custkey AS k, o_orderkey % 41 = 0 AS no_name, o_orderkey % 43 = 0 AS no_nat,
         CASE WHEN o_orderkey % 47 <> 0 THEN 'cli_' || o_custkey
              ELSE 'cli_' || substr(sha256(o_orderkey::VARCHAR), 1, 32) END AS client_id,
         CASE WHEN o_orderkey % 47 <> 0 THEN 'trc_' || o_custkey
              ELSE 'trc_' || substr(sha256(o_orderkey::VARCHAR), 1, 32) END AS trace_id
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_ids(fx.order_submissions(spark, sf_dir), "o_orderkey")


@query(f"SELECT o_orderkey, client_id, trace_id FROM ({_SUBMITTED})")
def ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submitted(spark, sf_dir).select("o_orderkey", "client_id", "trace_id")


@query(
    f"SELECT trace_id, client_id, 'ingest' AS stage, 'missing or empty: ' || concat_ws(',', CASE WHEN no_name THEN "
    f"'full_name' END, CASE WHEN no_nat THEN 'nationality' END) AS error_msg FROM ({_SUBMITTED}) WHERE no_name OR no_nat"
)
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejects(_submitted(spark, sf_dir)).select("trace_id", "client_id", "stage", "error_msg")


@query(
    f"SELECT o_orderkey, client_id, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY o_orderkey) = 1 "
    f"THEN 'ok' ELSE 'duplicate' END AS status FROM ({_SUBMITTED}) WHERE NOT no_name AND NOT no_nat"
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _submitted(spark, sf_dir).where(ingest.is_accepted())
    return ingest.with_ingest_status(accepted, "o_orderkey").select("o_orderkey", "client_id", "status")


@query(
    "SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"
)
def missing_raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for normalized rows; only customers in credit have a raw profile."""
    stored = fx.table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    raw = stored.select(F.concat(F.lit("cli_"), F.col("c_custkey").cast("string")).alias("client_id"))
    rows = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.concat(F.lit("cli_"), F.col("o_custkey").cast("string")).alias("client_id")
    )
    return ingest.with_raw_profile(rows, raw)[1].select("o_orderkey", "k")


@query("SELECT 'cli_' || c_custkey AS client_id, 'trc_' || c_custkey AS trace_id FROM customer WHERE c_custkey = 42")
def client_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_for(spark, sf_dir).raw.where("client_id = 'cli_42'").select("client_id", "trace_id")


# ------------------------------------------------------------------------------------------------ candidates
@query(with_ctes("SELECT entry_id, array_to_string(list_sort(keys), ' ') AS block_keys FROM entry", "entry"))
def entry_block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.flatten(F.transform(F.concat(F.array("entity_name"), "aliases"), lambda n: names.block_keys(n)))
    return fx.entries(spark, sf_dir).select(
        "entry_id", F.array_join(F.array_sort(F.array_distinct(every)), " ").alias("block_keys")
    )


@query(
    with_ctes(
        "SELECT p.k, v.provider_id, coalesce(max(c.total), 0)::BIGINT AS total FROM person p CROSS JOIN "
        "(VALUES ('world_check'), ('dow_jones'), ('comply_advantage')) v(provider_id) "
        "LEFT JOIN cand c ON c.name = p.name AND c.provider_id = v.provider_id GROUP BY 1, 2",
        "cand",
    )
)
def candidate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_for(spark, sf_dir).lookup.select("k", "provider_id", "total")


def _page(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    run = run_for(spark, sf_dir)
    asked = blocking.with_letters(run.profiles.select("canonical_name").distinct())
    pages = blocking.candidate_pages(asked, run.entries, limit)
    return asked.join(pages, "letters").select("canonical_name", "provider_id", "entry_id", F.col("rank").cast("bigint").alias("place"))


_PAGE = "SELECT name AS canonical_name, provider_id, entry_id, rn AS place FROM cand WHERE rn <= {n}"


@query(with_ctes(_PAGE.format(n=50), "cand"))
def candidate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, 50)


@query(with_ctes(_PAGE.format(n=7), "cand"))
def candidate_page_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page short enough to cut every list at any scale."""
    return _page(spark, sf_dir, 7)


@query(
    with_ctes(
        "SELECT k, provider_id, sha256(name) AS name_hash, 'v1' AS list_version, "
        "row_number() OVER (PARTITION BY name, provider_id ORDER BY k) > 1 AS cache_hit FROM person CROSS JOIN "
        "(VALUES ('world_check'), ('dow_jones'), ('comply_advantage')) v(provider_id)",
        "person",
    )
)
def lookup_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_for(spark, sf_dir).lookup.select("k", "provider_id", "name_hash", "list_version", "cache_hit")


# ------------------------------------------------------------------------------------------------ similarity
def _with_own_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile beside the one entry it was derived from."""
    run = run_for(spark, sf_dir)
    return run.profiles.withColumn("j", F.floor(F.col("k") / 15).cast("bigint")).join(
        run.entries.select("j", "entry_id", "entity_name", "aliases", F.col("dob_iso").cast("date").alias("entry_dob")).hint("merge"), "j"
    )


_SWAPPED = "array_to_string(list_sort(string_split(p.name, ' ')), ' ')"
_OWN = with_ctes(
    "SELECT p.k, p.name, p.dob, n.entry_id, n.pos, n.raw, e.dob AS edob, {plain} AS lcs1, {swapped} AS lcs2, "
    "n.len + length(p.name) AS total FROM person p JOIN entry e ON p.k // 15 = e.j JOIN ename n ON n.entry_id = e.entry_id",
    "person", "entry", "ename",
).format(
    plain=lcs("n.m1", "n.len", "p.name"),
    swapped=lcs("n.m2", "n.len", _SWAPPED),
)


_PLAIN = with_ctes(
    f"SELECT p.k, {lcs_plain('lower(n.raw)', 'p.name')} AS lcs1, {lcs_plain('n.sname', _SWAPPED)} AS lcs2, "
    "n.len + length(p.name) AS total FROM person p JOIN entry e ON p.k // 15 = e.j "
    "JOIN ename n ON n.entry_id = e.entry_id AND n.pos = 0",
    "person", "entry", "ename",
)


@query(
    "SELECT k, lcs1::INTEGER AS lcs, round_even(2.0::DOUBLE * lcs1 / total, 6)::DOUBLE AS ratio, "
    f"round_even(2.0::DOUBLE * greatest(lcs1, lcs2) / total, 6)::DOUBLE AS similarity FROM ({_PLAIN})"
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _with_own_entry(spark, sf_dir).select("k", "canonical_name", "entity_name")
    a, b = F.col("canonical_name"), F.col("entry_cname")
    # Each distinct pair of names once, spread over all tasks.
    pairs = simjoin.spread(own.select("canonical_name", "entity_name").distinct(), "canonical_name", "entity_name")
    pairs = pairs.withColumn("entry_cname", names.canonical_name(F.col("entity_name")))
    pairs = pairs.withColumn("lcs", similarity.lcs_length(b, a)).withColumn(
        "swapped", similarity.lcs_length(names.token_sorted(a), names.token_sorted(b))
    )
    return own.join(pairs.hint("merge"), ["canonical_name", "entity_name"]).select(
        "k",
        F.col("lcs").cast("int").alias("lcs"),
        F.bround(similarity.ratio_of(F.col("lcs"), a, b), 6).alias("ratio"),
        F.bround(similarity.ratio_of(F.greatest("lcs", "swapped"), a, b), 6).alias("similarity"),
    )


@query()
def matches_long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of up to 1,000 letters, every passage of every document: clients spell them with each ninth letter left out."""
    clients, entries = fx.long_names(spark, sf_dir)
    clients, names_ = stored(clients, "long-clients"), stored(lists.entry_names(entries), "long-names")
    return simjoin.all_matches(clients, names_).select(
        "doc_id", "passage", "entry_id", F.length("canonical_name").alias("letters"), "score", "dob_match"
    )


_PAIR_SCORE = (
    "round_even(CASE WHEN edob IS NULL THEN base WHEN dob = edob THEN least(1.0::DOUBLE, base + 0.03::DOUBLE) "
    "ELSE least(base, 0.75::DOUBLE) END, 4)::DOUBLE"
)
_OWN_SCORED = f"SELECT *, {_PAIR_SCORE} AS score FROM (SELECT *, 2.0::DOUBLE * greatest(lcs1, lcs2) / total AS base FROM ({_OWN}))"


@query(
    f"SELECT k, CASE WHEN edob IS NULL THEN 'unknown' WHEN dob = edob THEN 'same' ELSE 'different' END AS relation, score "
    f"FROM ({_OWN_SCORED}) WHERE pos = 0"
)
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _with_own_entry(spark, sf_dir).select("k", "canonical_name", "entity_name", "dob_iso", "entry_dob")
    relation = similarity.dob_relation(F.col("dob_iso"), F.col("entry_dob"))
    return simjoin.with_similarity(own, "canonical_name", "entity_name").select(
        "k", relation.alias("relation"), similarity.with_dob(F.col("base"), relation).alias("score")
    )


@query(
    f"SELECT k, raw AS matched_name, score, coalesce(dob = edob, false) AS dob_match FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY k ORDER BY score DESC, pos) AS place FROM ({_OWN_SCORED})) WHERE place = 1"
)
def best_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.posexplode(F.concat(F.array("entity_name"), "aliases")).alias("pos", "name")
    relation = similarity.dob_relation(F.col("dob_iso"), F.col("entry_dob"))
    own = _with_own_entry(spark, sf_dir).select("k", "canonical_name", "dob_iso", "entry_dob", every)
    scored = (
        simjoin.with_similarity(own, "canonical_name", "name")
        .withColumn("score", similarity.with_dob(F.col("base"), relation))
        .withColumn("dob_match", F.coalesce(F.col("dob_iso") == F.col("entry_dob"), F.lit(False)))
    )
    best = F.min_by(F.struct("name", "score", "dob_match"), F.struct(-F.col("score"), F.col("pos"))).alias("b")
    return scored.groupBy("k").agg(best).select("k", F.col("b.name").alias("matched_name"), "b.score", "b.dob_match")


# ------------------------------------------------------------------------------------------------ matches
def _match_view(match: DataFrame) -> DataFrame:
    return match.select(
        "match_id", "client_id", "provider_id", "list_type", "matched_name", "score", "dob_match", "evidence_ref",
        "pep_tier", "media_confidence",
    )


_MATCH = (
    f"SELECT {_sid('mat', 'screening_id || chr(124) || entry_id')} AS match_id, client_id, "
    "provider_id, list_type, matched_name, score, coalesce(same_dob, false) AS dob_match, entry_id AS evidence_ref, "
    "pep_tier, media_confidence FROM {t}"
)


@query(with_ctes(_MATCH.format(t="match"), "match"))
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    return _match_view(screen.matches(run.profiles, run.entries, run.state, None, run.names))


@query(with_ctes(_MATCH.format(t="match50"), "match50"))
def matches_page50(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir, 50)
    return _match_view(screen.matches(run.profiles, run.entries, run.state, 50, run.names))


@query(with_ctes(_MATCH.format(t="match_degraded"), "match_degraded"))
def matches_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider answers nothing; the others still count."""
    run = run_for(spark, sf_dir)
    return _match_view(screen.matches(run.profiles, run.entries, _degraded_state(), None, run.names))


def _degraded_state() -> list[lists.ProviderState]:
    return [
        lists.ProviderState(s.list_type, s.provider_id, s.list_version, s.provider_id == "dow_jones")
        for s in lists.default_state()
    ]


_SUMMARY = """
SELECT p.screening_id, p.client_id, p.trace_id, p.profile_hash, 'completed' AS status, 3 AS providers_queried,
       coalesce(c.candidates, 0)::BIGINT AS candidates, coalesce(m.n, 0)::BIGINT AS matches,
       coalesce(m.top, 0.0)::DOUBLE AS max_score, (CASE WHEN p.place > 1 THEN {hits} ELSE 0 END)::INTEGER AS cache_hits,
       {versions} AS list_versions, '{degraded}' AS degraded_providers
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS place FROM person) p
LEFT JOIN (SELECT name, sum(least(total, {limit})) AS candidates FROM
  (SELECT name, provider_id, max(total) AS total FROM cand WHERE {only} GROUP BY 1, 2) GROUP BY 1) c ON p.name = c.name
LEFT JOIN (SELECT k, count(*) AS n, max(score) AS top FROM {match} GROUP BY 1) m ON p.k = m.k"""
_VERSIONS = "'comply_advantage=v1,dow_jones=v1,world_check=v1'"


def _screening_view(screening: DataFrame) -> DataFrame:
    versions = F.array_sort(F.transform(F.map_entries("list_versions"), lambda e: F.concat_ws("=", e.key, e.value)))
    return screening.select(
        "screening_id", "client_id", "trace_id", "profile_hash", "status", "providers_queried", "candidates", "matches",
        "max_score", "cache_hits", F.array_join(versions, ",").alias("list_versions"),
        joined("degraded_providers").alias("degraded_providers"),
    )


@query(
    with_ctes(
        _SUMMARY.format(hits=3, versions=_VERSIONS, degraded="", limit=1000000000, only="true", match="match"), "match", "cand"
    )
)
def screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screening_view(run_for(spark, sf_dir).screened.screening)


@query(
    with_ctes(
        _SUMMARY.format(hits=3, versions=_VERSIONS, degraded="", limit=50, only="true", match="match50"), "match50", "cand"
    )
)
def screenings_page50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screening_view(run_for(spark, sf_dir, 50).screened.screening)


@query(
    with_ctes(
        _SUMMARY.format(
            hits=2, versions=_VERSIONS, degraded="dow_jones", limit=1000000000, only="provider_id <> 'dow_jones'", match="match_degraded"
        ),
        "match_degraded",
        "cand",
    )
)
def screenings_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    done = screen.screen(run.profiles, run.entries, _degraded_state(), None, "k", names=run.names)
    return _screening_view(done.screening)


@query(
    with_ctes(
        "SELECT client_id, entry_id AS evidence_ref, score, 'left' AS side FROM match "
        "EXCEPT SELECT client_id, entry_id, score, 'left' FROM match10",
        "match", "match10",
    )
)
def page_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity check of two result sets: what a ten-row page misses against the whole lists."""
    run = run_for(spark, sf_dir)
    columns = ["client_id", "evidence_ref", "score"]
    short = screen.matches(run.profiles, run.entries, run.state, 10, run.names)
    return screen.parity_differences(run.match.select(columns), short.select(columns))


# ------------------------------------------------------------------------------------------------ decisions
_DECISION = "SELECT decision_id, screening_id, client_id, trace_id, outcome, reason_codes, top_match_id FROM {t}"


def _decision_view(decision: DataFrame) -> DataFrame:
    return decision.select(
        "decision_id", "screening_id", "client_id", "trace_id", "outcome", joined("reason_codes").alias("reason_codes"),
        "top_match_id",
    )


@query(with_ctes(_DECISION.format(t="decision"), "decision"))
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    return _decision_view(decide.decide(run.screening, run.match, run.rules))


@query(with_ctes(_DECISION.format(t="decision50"), "decision50"))
def decisions_page50(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir, 50)
    return _decision_view(decide.decide(run.screening, run.match, run.rules))


@query(
    with_ctes(
        "SELECT client_id, reason_codes FROM decision WHERE outcome = 'ESCALATE'",
        "decision",
    )
)
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end from raw submissions, with nothing prepared: which clients escalate, and why."""
    run = Run(spark, sf_dir)
    match = screen.matches(run.profiles, run.entries, run.state, None, run.names)
    decided = decide.decide(run.profiles, match, run.rules)
    return decided.where("outcome = 'ESCALATE'").select("client_id", joined("reason_codes").alias("reason_codes"))


@query(
    with_ctes(
        "SELECT screening_id, row_number() OVER (PARTITION BY screening_id ORDER BY rule_ord, list_ord, entry_id) AS step, "
        "rule, list_type, CASE sev WHEN 3 THEN 'ESCALATE' ELSE 'FLAG' END AS outcome, score, pep_tier, match_id AS match_ref "
        "FROM trace",
        "trace",
    )
)
def rule_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    order = Window.partitionBy("screening_id").orderBy("rule_ord", "list_ord", "entry_ord")
    return (
        decide.rule_trace(run.match, run.rules)
        .withColumn("step", F.row_number().over(order).cast("bigint"))
        .select("screening_id", "step", "rule", "list_type", "outcome", "score", "pep_tier", "match_ref")
    )


@query(
    with_ctes(
        "SELECT d.decision_id, d.trace_id, d.screening_id, p.profile_hash, d.outcome, d.reason_codes, "
        "coalesce(m.n, 0)::INTEGER AS matches, m.top AS first_entry, coalesce(t.n, 0)::INTEGER AS rule_steps "
        "FROM decision d JOIN person p ON d.k = p.k LEFT JOIN (SELECT k, count(*) AS n, arg_min(entry_id, (CASE list_type "
        "WHEN 'sanctions' THEN 1 WHEN 'pep' THEN 2 ELSE 3 END, entry_id)) AS top FROM match GROUP BY 1) m ON d.k = m.k "
        "LEFT JOIN (SELECT k, count(*) AS n FROM trace GROUP BY 1) t ON d.k = t.k",
        "decision", "person", "match", "trace",
    )
)
def audit_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON snapshot, read back."""
    run = run_for(spark, sf_dir)
    shape = (
        "screening_id string, profile_hash string, outcome string, reason_codes array<string>, "
        "matches array<struct<evidence_ref:string>>, rule_trace array<struct<rule:string>>"
    )
    return (
        run.audit.select("decision_id", "trace_id", F.from_json("snapshot", shape).alias("s"))
        .select("decision_id", "trace_id", "s.*")
        .select(
            "decision_id", "trace_id", "screening_id", "profile_hash", "outcome", joined("reason_codes").alias("reason_codes"),
            F.size("matches").alias("matches"), F.get("matches", F.lit(0)).evidence_ref.alias("first_entry"),
            F.size("rule_trace").alias("rule_steps"),
        )
    )


# ------------------------------------------------------------------------------------------------ uniqueness
_MSG = (
    "SELECT event_id, user_id || ':' || event_type || ':' || (event_id % 3) || ':' || (event_id // 3) AS message_key "
    "FROM events"
)


@query(f"SELECT message_key, event_id FROM ({_MSG}) WHERE event_id % 7 <> 0")
def unprocessed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered messages once each, without those whose key is stored."""
    key = fields.message_key(F.col("trace_id"), F.col("topic"), F.col("partition"), F.col("offset"))
    delivered = fx.redelivered(spark, sf_dir).select(key.alias("message_key"), "event_id", "delivery")
    stored = fx.messages(spark, sf_dir).where("event_id % 7 = 0").select(key.alias("key"))
    return dedup.unprocessed(delivered, stored, "delivery").select("message_key", "event_id")


@query(
    with_ctes(
        "SELECT client_id, profile_hash, min(o_orderkey) AS o_orderkey FROM (SELECT o_orderkey, client_id, sha256(CASE WHEN "
        "no_name THEN '' ELSE name END || '|' || dob::VARCHAR || '|' || CASE WHEN no_nat THEN '' ELSE coalesce(nat, '') END) "
        f"AS profile_hash FROM ({_SUBMITTED}) s JOIN person p ON s.k = p.k) GROUP BY 1, 2".replace(
            "o_orderkey, client_id, sha256", "s.o_orderkey, s.client_id, sha256"
        ),
        "person",
    )
)
def first_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalized row per client and hash; the first submission wins."""
    normalized = normalize.normalize(_submitted(spark, sf_dir)).select("client_id", "profile_hash", "o_orderkey")
    nothing = normalized.where(F.lit(False))
    return dedup.new_profiles(normalized, nothing, "o_orderkey").select("client_id", "profile_hash", "o_orderkey")


@query("SELECT o_custkey::VARCHAR AS screening_id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def one_decision_per_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for decision messages about their customer's screening."""
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("screening_id"), "o_orderkey")
    return dedup.new_for_screening(rows, rows.where(F.lit(False)), "o_orderkey").select("screening_id", "o_orderkey")


@query(
    "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag = 'N' THEN 'list_type' END, "
    "CASE WHEN l_discount * 20 > 1 THEN 'score' END) AS failed_checks FROM lineitem "
    "WHERE l_returnflag = 'N' OR l_discount * 20 > 1"
)
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for match rows: a flag outside the three lists and a score over one are refused."""
    flag = F.col("l_returnflag")
    rows = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag == "A", "pep").when(flag == "R", "sanctions").otherwise(flag).alias("list_type"),
        (F.col("l_discount") * 20).alias("score"),
    )
    bad = dedup.check_domains(rows, "match")[1]
    return bad.select("l_orderkey", "l_linenumber", joined("failed_checks").alias("failed_checks"))


# ------------------------------------------------------------------------------------------------ reconciliation
@query(
    with_ctes(
        "SELECT entry_id, provider_id, list_type, entity_name, array_to_string(aliases, ',') AS aliases, dob::VARCHAR AS dob_iso "
        "FROM entry2",
        "entry2",
    )
)
def served_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    return reconcile.served_list(run.entries, run.updates).select(
        "entry_id", "provider_id", "list_type", "entity_name", joined("aliases").alias("aliases"), "dob_iso"
    )


@query(
    with_ctes(
        "SELECT e.entry_id, e.entity_name, CASE WHEN u.change = 'remove' THEN 'v2' ELSE 'v1' END AS list_version, "
        "u.change <> 'remove' AS is_active FROM entry e JOIN upd u ON e.j = u.j UNION ALL "
        "SELECT 'wl_' || list_type || '_u' || printf('%04d', j), added_name, 'v2', true FROM upd WHERE change = 'add'",
        "entry", "upd",
    )
)
def mirror_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_for(spark, sf_dir)
    mirror = reconcile.upsert_mirror(run.entries.withColumn("is_active", F.lit(True)), run.updates)
    return mirror.select("entry_id", "entity_name", "list_version", "is_active")


def _order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a history per customer: an outcome and list versions at each order date."""
    o = F.col("o_orderkey")
    version = F.concat(F.lit("v"), (1 + o % 4).cast("string"))
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"),
        o.alias("screening_id"),
        o.alias("decision_id"),
        F.col("o_orderdate").cast("timestamp").alias("screened_at"),
        F.col("o_orderdate").cast("timestamp").alias("decided_at"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("outcome"),
        F.sha2(F.col("o_totalprice").cast("string"), 256).alias("profile_hash"),
        F.create_map(F.lit("world_check"), version, F.lit("dow_jones"), F.lit("unknown")).alias("list_versions"),
    )


@query(
    "SELECT o_custkey::VARCHAR AS client_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS screening_id, "
    "'v' || (1 + arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 4) AS world_check FROM orders GROUP BY 1"
)
def latest_screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_screening(_order_history(spark, sf_dir).drop("profile_hash")).select(
        "client_id", "screening_id", F.col("list_versions")["world_check"].alias("world_check")
    )


@query(
    "SELECT o_custkey::VARCHAR AS client_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS outcome FROM orders GROUP BY 1"
)
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_outcome(_order_history(spark, sf_dir))


@query(
    "SELECT client_id, arg_max(o_orderkey, (created_at, o_orderkey)) AS o_orderkey FROM (SELECT o_custkey::VARCHAR AS "
    "client_id, o_orderdate AS created_at, o_orderkey FROM orders) GROUP BY 1"
)
def latest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_history(spark, sf_dir).select(
        "client_id", "created_at", F.format_string("%012d", "screening_id").alias("profile_hash"), F.col("screening_id").alias("o_orderkey")
    )
    return reconcile.latest_profile(rows).select("client_id", "o_orderkey")


_AFFECTED = """
WITH used AS (SELECT o_custkey::VARCHAR AS client_id, 1 + arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 4 AS wc FROM orders GROUP BY 1)
SELECT client_id, 'world_check' AS provider_id, 'v' || wc AS old_version FROM used WHERE wc < 3
UNION ALL SELECT client_id, 'dow_jones', 'unknown' FROM used"""


@query(_AFFECTED)
def affected_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new versions: world_check v3 outdates v1 and v2, dow_jones v1 outdates an unknown version."""
    used = reconcile.used_versions(_order_history(spark, sf_dir))
    parts = [
        reconcile.affected_clients(used, provider, version).withColumn("provider_id", F.lit(provider))
        for provider, version in (("world_check", "v3"), ("dow_jones", "v1"))
    ]
    return parts[0].unionByName(parts[1]).select("client_id", "provider_id", "old_version")


# The lists change in the order in which their first update arrives: supplier 0 is sanctions, 1 pep, 2 adverse media.
_ROUNDS = [("world_check", "decision", "decision_s"), ("dow_jones", "decision_s", "decision_p"), ("comply_advantage", "decision_p", "decision2")]
_DRIFT = " UNION ALL ".join(
    f"SELECT '{provider}' AS provider_id, d.client_id, d.trace_id, d.outcome AS prior_outcome, n.outcome AS new_outcome, n.reason_codes, "
    "CASE WHEN d.outcome = 'CLEAR' AND n.outcome <> 'CLEAR' THEN 'newly_flagged' "
    "WHEN d.outcome <> 'CLEAR' AND n.outcome = 'CLEAR' THEN 'newly_cleared' ELSE 'unchanged' END AS drift "
    f"FROM {before} d JOIN {after} n ON d.k = n.k"
    for provider, before, after in _ROUNDS
)
_DECISIONS = ["decision", "decision_s", "decision_p", "decision2"]


@query(with_ctes(f"SELECT provider_id, client_id, prior_outcome, new_outcome, reason_codes, drift FROM ({_DRIFT})", *_DECISIONS))
def outcome_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run_for(spark, sf_dir).reconciled
    codes = done.decision.select("screening_id", joined("reason_codes").alias("reason_codes"))
    return done.drift.join(codes, "screening_id").select(
        "provider_id", "client_id", "prior_outcome", "new_outcome", "reason_codes", "drift"
    )


@query(
    with_ctes(
        "SELECT u.j AS seq, u.provider_id, u.list_type, CASE WHEN u.first THEN 'v1' END AS old_version, 'v2' AS new_version, "
        "CASE WHEN u.first THEN r.n ELSE 0 END::INTEGER AS clients_rescreened, "
        "CASE WHEN u.first THEN r.f ELSE 0 END::INTEGER AS newly_flagged, "
        "CASE WHEN u.first THEN r.c ELSE 0 END::INTEGER AS newly_cleared "
        "FROM (SELECT *, j = min(j) OVER (PARTITION BY provider_id) AS first FROM upd) u JOIN (SELECT provider_id, count(*) AS n, "
        "count_if(drift = 'newly_flagged') AS f, count_if(drift = 'newly_cleared') AS c FROM drift GROUP BY 1) r USING (provider_id)",
        *_DECISIONS, "upd",
        drift=_DRIFT,
    )
)
def reconciliation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per update event; the ids are traced back to the events they are made of."""
    run = run_for(spark, sf_dir)
    order = run.updates.select("seq", reconcile.run_id().alias("id"))
    return run.reconciled.runs.join(order, "id").select(
        "seq", "provider_id", "list_type", "old_version", "new_version", "clients_rescreened", "newly_flagged", "newly_cleared"
    )


@query(
    with_ctes(
        f"SELECT provider_id, client_id, trace_id, new_outcome AS outcome, reason_codes FROM ({_DRIFT})",
        *_DECISIONS,
    )
)
def rescreen_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision of a re-screening has its audit row; the snapshot is read back."""
    done = run_for(spark, sf_dir).reconciled
    shape = "screening_id string, client_id string, outcome string, reason_codes array<string>"
    told = done.audit.select("decision_id", "trace_id", F.from_json("snapshot", shape).alias("s")).select("decision_id", "trace_id", "s.*")
    known = done.decision.select("decision_id").join(done.audit.select("decision_id").distinct(), "decision_id")
    return (
        told.join(known, "decision_id")
        .join(done.drift.select("screening_id", "provider_id"), "screening_id")
        .select("provider_id", "client_id", "trace_id", "outcome", joined("reason_codes").alias("reason_codes"))
    )


@query(
    with_ctes(
        "SELECT u.change, n.client_id, n.outcome AS new_outcome, n.outcome = CASE WHEN u.change = 'add' AND u.list_type = "
        "'sanctions' THEN 'ESCALATE' ELSE 'CLEAR' END AS ok FROM upd u JOIN decision2 n ON n.k = CASE u.change WHEN 'add' "
        "THEN u.ck ELSE u.j * 15 END WHERE u.list_type = 'sanctions' AND u.change <> 'version_bump'",
        "upd", "decision2",
    )
)
def scenario_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanctions scenarios: the person of an added entry should escalate, that of a removed one should clear."""
    run = run_for(spark, sf_dir)
    j = F.col("seq")
    expected = run.updates.where("list_type = 'sanctions' and change <> 'version_bump'").select(
        "change",
        F.concat(
            F.lit("cli_"), F.when(F.col("change") == "add", j * 15 + 3 + j % 12).otherwise(j * 15).cast("string")
        ).alias("client_id"),
        F.when(F.col("change") == "add", "ESCALATE").otherwise("CLEAR").alias("expected_outcome_after"),
    )
    known = expected.join(run.profiles.select("client_id"), "client_id", "left_semi")
    last = run.reconciled.drift.where("provider_id = 'comply_advantage'")
    return reconcile.scenario_check(last, known).select("change", "client_id", "new_outcome", "ok")
