"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm import (
    alignment,
    bpe_automaton,
    common,
    cotraining,
    decontaminate,
    hamming_dedup,
    language_id,
    license_scan,
    pii,
    quality_rules,
    resampling,
    token_counts,
    token_orc,
    warc,
)

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file; it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL; held against the tokenizers library in the tests."""
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), tokenizer())


@query()
def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL; held against the tokenizers library in the tests."""
    path = common.new_folder(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents"), tokenizer(), path, end_id=0)
    return token_orc.located(token_orc.read(spark, path))


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL (encoded lengths); held against the tokenizers library in the tests."""
    docs = table(spark, sf_dir, "documents")
    hist = token_counts.histogram(token_counts.lengths(docs, tokenizer()))
    return token_counts.limits(common.stored(hist, "length-histogram"))  # read twice


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows and lines of whole tables are too slow in SQL; held against brute force in the tests.

    Near duplicates are still in the table, so exact copies count as one document.
    """
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), copies_once=True)
    names = "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    return judged.select(*names, "n_removed", "n_common_lines")


@query()
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over whole tables are too slow in SQL; held against brute force in the tests."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return decontaminate.matched(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by position need loops that SQL lacks; held against brute force in the tests."""
    base = [k.name for k in pii.KINDS if k.base]
    every = [k.name for k in pii.KINDS]
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(every).alias("spans"),
    )


@query(
    "WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), "
    "g AS (SELECT body, max(page_id) AS largest FROM p GROUP BY body) "
    "SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, "
    "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    "list_reduce(list_transform(range(5), lambda j: instr('01', bits[1 + 5 * i + j]) - 1), lambda a, b: 2 * a + b), 1)), "
    "'string_agg', '') AS payload_digest, "
    "CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> largest THEN largest END AS refers_to "
    "FROM (SELECT page_id, body, largest, list_aggregate(list_transform(range(40), lambda k: "
    "bit_of[1 + instr('0123456789abcdef', sha1(body)[1 + k]) - 1]), 'string_agg', '') AS bits "
    "FROM p JOIN g USING (body), (SELECT ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', "
    "'1010', '1011', '1100', '1101', '1110', '1111'] AS bit_of))"
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), common.new_folder(spark, "warc"), least=0)
    return warc.read(manifest)


@query()
def op7_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs and reachability are too slow in SQL over whole tables; held against brute force in the tests."""
    return hamming_dedup.linked(table(spark, sf_dir, "documents"), size=3, percent=85)


@query()
def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL (a trained model); held-out accuracy is tested."""
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL (a trained model); held-out accuracy is tested."""
    return language_id.identify(table(spark, sf_dir, "documents"))


# One step of a byte through the checksum's polynomial, for all 256 bytes; then words byte by byte.
_CRC_TABLE = (
    "SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: "
    "CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc"
)
_WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    f"WITH crc_of AS ({_CRC_TABLE}), "
    f"d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text='text')} AS words FROM documents), "
    "dw AS (SELECT r, unnest(words) AS word FROM d), "
    f"bw AS (SELECT unnest({_WORDS.format(text='text')}) AS word FROM benchmark), "
    "every AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), "
    "hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), "
    "lambda i: ('0x' || substr(hex(encode(word)), (1 + 2 * i)::INT, 2))::BIGINT))::BIGINT[], "
    "lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM every, crc_of), "
    "s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket), "
    "t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket), "
    "gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE) / "
    "((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)), "
    "weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r), "
    "scored AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + "
    "floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score "
    "FROM d LEFT JOIN weighed USING (r)), "
    "ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"
)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of rules and the choice between their matches are not SQL; held against brute force in the tests."""
    at = F.transform("base", lambda x: x.word)
    base = F.transform("base", lambda x: x.label)
    found = F.transform("detections", lambda x: x.label)
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, found)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x.sure)), F.lit(0.0)).alias("score"),
    )


@query()
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not in SQL (two encodings); held against the libraries and a plain merge in the tests."""
    return alignment.measured(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))
