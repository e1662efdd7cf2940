"""Profiles, lists, updates and messages derived from the given tables.

Whole-number, array and substring arithmetic only, so any SQL engine gives the same rows. About one profile in eight
is planted from a list entry, one in fifteen is a hard negative (same name, other birth date), the rest is background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.functions.names import canonical_name
from vettra.operators.simjoin import spread
from vettra.schemas import DOCUMENTS, RISK

# --- fixed values: name pools and field pools of the derived data set ----------------------------------------------
FIRST_HEAD = "al be da el gre ivo mar ni ro ser".split()
FIRST_TAIL = "na rek vin to lia mir".split()
LAST_HEAD = "pet vol kuz smir del gar men nov sid tan".split()
LAST_TAIL = "rov kova ard escu ingham ov".split()
NATIONALITIES = [
    "Russia", "Cyprus", "UKRAINE", "United  Kingdom", "usa", "Germany", "France", "ES", "Italy", "Netherlands",
    "Switzerland", "China", "Iran", "Syria", "North Korea", "South Korea", "Belarus", "Kazakhstan", "Türkiye", "Poland",
    "Portugal", "Greece.", "at", "Atlantis", "UK",
]
PROGRAMS = [f"PROG-{i}" for i in range(1, 8)]
COUNTRIES = "AT BE BG CZ DK EE FI GR HU IT JP".split()
EPOCH = "1940-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(pool: list[str], index: Column) -> Column:
    return F.get(F.split(F.lit("|".join(pool)), "[|]"), index.cast("int"))


def _div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(n)).cast("bigint")


def first_name(x: Column) -> Column:
    f = (x * 31) % 60
    return F.concat(_pick(FIRST_HEAD, f % 10), _pick(FIRST_TAIL, _div(f, 10)))


def last_name(x: Column) -> Column:
    n = (x * 17 + _div(x, 60)) % 60
    return F.concat(_pick(LAST_HEAD, n % 10), _pick(LAST_TAIL, _div(n, 10)))


def day(offset: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), (offset % 20000).cast("int"))


def _list_of(j: Column) -> tuple[Column, Column]:
    kind = j % 3
    list_type = F.when(kind == 0, "sanctions").when(kind == 1, "pep").otherwise("adverse_media")
    provider = F.when(kind == 0, "world_check").when(kind == 1, "dow_jones").otherwise("comply_advantage")
    return list_type, provider


def entry_id(list_type: Column, j: Column, mark: str = "_") -> Column:
    """At least four digits; ``mark`` keeps added entries apart from listed ones at any number."""
    return F.concat(F.lit("wl_"), list_type, F.lit(mark), F.format_string("%04d", j))


def _risk(j: Column, name: Column) -> Column:
    kind = j % 3
    return F.struct(
        F.when(kind == 0, _pick(PROGRAMS, j % len(PROGRAMS))).alias("program"),
        F.when(kind == 1, 1 + _div(j, 3) % 4).cast("int").alias("pep_tier"),
        F.when(kind == 2, (30 + j % 70) / 100.0).alias("media_confidence"),
        F.when(
            kind == 2,
            F.slice(
                F.array(
                    *[
                        F.struct(F.concat(name, F.lit(text)).alias("headline"), F.lit(f"src_{i}").alias("source"))
                        for i, text in enumerate(
                            (
                                " named in a customs case",
                                " appears before a court",
                                " is asked about an invoice",
                            )
                        )
                    ]
                ),
                1,
                (1 + j % 3).cast("int"),
            ),
        ).alias("articles"),
    ).cast(RISK)


def entries(spark: SparkSession, sf_dir: str, version: str = "v1") -> DataFrame:
    """List entries, one per supplier."""
    j = F.col("j")
    list_type, provider = _list_of(j)
    first, last = first_name(j), last_name(j)
    name = F.concat_ws(" ", first, last)
    swapped = F.concat_ws(" ", last, first)
    spelled = F.concat_ws(" ", first, F.concat(F.regexp_replace(last, "v$", ""), F.lit("ff")))
    return (
        spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("j")), "j")
        .select(
            "j",
            entry_id(list_type, j).alias("entry_id"),
            provider.alias("provider_id"),
            list_type.alias("list_type"),
            F.lit(version).alias("list_version"),
            name.alias("entity_name"),
            F.when(last.endswith("v"), F.array(swapped, spelled)).otherwise(F.array(swapped)).alias("aliases"),
            F.when(j % 20 != 0, day(j * 37)).cast("string").alias("dob_iso"),
            _pick(COUNTRIES, j % len(COUNTRIES)).alias("country_iso2"),
            _risk(j, name).alias("risk_payload"),
        )
    )


def clean_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name, dob): the people behind the customers, already canonical."""
    k, j, r = F.col("k"), F.col("j"), F.col("r")
    first, last = first_name(j), last_name(j)
    perturbed = (
        F.when(j % 3 == 0, F.concat_ws(" ", last, first))
        .when(j % 3 == 1, F.concat_ws(" ", first, F.expr("substring(last, 1, length(last) - 1)")))
        .otherwise(F.concat(first, F.lit(" "), last, F.lit("a")))
    )
    x = k * 7 + 3
    planted = F.when(r == 1, perturbed).otherwise(F.concat_ws(" ", first, last))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_nationkey").alias("nation"))
    # A small file of many rows is one task; spread before anything is worked out.
    return (
        spread(rows, "k")
        .withColumns({"j": _div(k, 15), "r": k % 15})
        .withColumn("last", last)
        .select(
            "k",
            "nation",
            F.when(r <= 2, planted).otherwise(F.concat_ws(" ", first_name(x), last_name(x))).alias("name"),
            F.when(r <= 1, day(j * 37))
            .when(r == 2, F.date_add(day(j * 37), 1))
            .otherwise(day(k * 53 + 11))
            .alias("dob"),
        )
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw KYC rows, one per customer, with the dirt that normalisation must undo."""
    k, name, dob = F.col("k"), F.col("name"), F.col("dob")
    dirt = k % 3
    full_name = (
        F.when(dirt == 0, F.upper(name))
        .when(dirt == 1, F.concat(F.lit(" "), F.regexp_replace(name, " ", "   "), F.lit(".")))
        .otherwise(F.translate(name, "aeo", "áéö"))
    )
    dob_text = (
        F.when(dirt == 0, F.date_format(dob, "yyyy-MM-dd"))
        .when(dirt == 1, F.date_format(dob, "dd/MM/yyyy"))
        .otherwise(F.date_format(dob, "d.M.yyyy"))
    )
    document = F.struct(F.lit("passport").alias("type"), F.concat(F.lit("P"), k.cast("string")).alias("value"))
    return clean_profiles(spark, sf_dir).select(
        "k",
        F.concat(F.lit("cli_"), k.cast("string")).alias("client_id"),
        F.concat(F.lit("trc_"), k.cast("string")).alias("trace_id"),
        full_name.alias("full_name"),
        dob_text.alias("dob"),
        _pick(NATIONALITIES, F.col("nation")).alias("nationality"),
        F.when(k % 5 != 0, _pick(NATIONALITIES, k % 25)).alias("residence_country"),
        F.when(k % 4 == 0, F.array(document)).cast(DOCUMENTS).alias("document_ids"),
        F.timestamp_seconds(F.lit(1704067200) + k).alias("created_at"),
    )


def order_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one submission by its customer: many repeats, some rows with a required field missing."""
    o = F.col("o_orderkey")
    people = submissions(spark, sf_dir).drop("created_at")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("k")
    )
    return (
        orders.join(people, "k")
        .withColumn("full_name", F.when(o % 41 != 0, F.col("full_name")).otherwise(""))
        .withColumn("nationality", F.when(o % 43 != 0, F.col("nationality")))
        .withColumn("client_id", F.when(o % 47 != 0, F.col("client_id")))
        .withColumn("trace_id", F.when(o % 47 != 0, F.col("trace_id")))
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List changes, one per supplier: a third add, a third remove, a third only raise the version to v2."""
    j = F.col("j")
    list_type, provider = _list_of(j)
    kind = _div(j, 3) % 3
    k = j * 15 + 3 + j % 12  # the customer an added entry describes
    x = k * 7 + 3
    name = F.concat_ws(" ", first_name(x), last_name(x))
    added_id, listed_id = entry_id(list_type, j, "_u"), entry_id(list_type, j)
    change = F.when(kind == 0, "add").when(kind == 1, "remove").otherwise("version_bump")
    entry = F.struct(
        F.when(kind == 0, added_id).otherwise(listed_id).alias("entry_id"),
        provider.alias("provider_id"),
        list_type.alias("list_type"),
        F.lit("v2").alias("list_version"),
        F.when(kind == 0, name).otherwise(F.lit("renamed upstream")).alias("entity_name"),
        F.array().cast("array<string>").alias("aliases"),
        F.when(kind == 0, day(k * 53 + 11).cast("string")).alias("dob_iso"),
        F.lit(None).cast("string").alias("country_iso2"),
        _risk(j, name).alias("risk_payload"),
    )
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("j"))
        .select(
            j.alias("seq"),
            provider.alias("provider_id"),
            list_type.alias("list_type"),
            change.alias("change"),
            F.when(kind != 2, entry).alias("entry"),
            F.lit("v2").alias("new_list_version"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as delivered messages."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_type").alias("topic"),
        (e % 3).cast("int").alias("partition"),
        _div(e, 3).alias("offset"),
        F.col("ts").cast("timestamp").alias("produced_at"),
        "value",
        "props",
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, with every tenth delivered twice."""
    once = messages(spark, sf_dir).withColumn("delivery", F.lit(1))
    again = messages(spark, sf_dir).where("event_id % 10 = 0").withColumn("delivery", F.lit(2))
    return once.unionByName(again)


def long_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(clients, entries) named by the passages of the documents: whole texts, cut every 1,000 characters.

    Two passages in a row share a birth date, so that each client also meets a name that is not its own.
    """
    cut = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,1000}"), F.lit(0))).alias("passage", "written")
    day = F.pmod(F.xxhash64("doc_id", F.floor(F.col("passage") / 2)), F.lit(40_000)).cast("int")
    passages = table(spark, sf_dir, "documents").select("doc_id", cut).withColumn("dob_iso", F.date_add(F.lit("1900-01-01"), day))
    # A text becomes many names: spread before anything is worked out.
    passages = spread(passages, "doc_id", "passage")
    entries = passages.select(
        F.format_string("wl_%d_%d", "doc_id", "passage").alias("entry_id"),
        F.col("written").alias("entity_name"),
        F.array().cast("array<string>").alias("aliases"),
        "dob_iso",
    )
    spelled = canonical_name(F.regexp_replace("written", "(?s)(.{8}).", "$1"))
    return passages.select("doc_id", "passage", "dob_iso", spelled.alias("canonical_name")).where("canonical_name <> ''"), entries
