"""Declared-schema readers for the data files, and dataset fingerprints."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra import schemas

MAX_EXACT_ROWS = 100_000
LIST_FILES = {"sanctions": "sanctions.jsonl", "pep": "pep.jsonl", "adverse_media": "adverse_media.jsonl"}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema. Blank lines are skipped; a missing path gives an empty frame."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_watchlist(spark: SparkSession, folder: str, list_type: str) -> DataFrame:
    """One list file; ``served_as`` tells which list the file belongs to, whatever its rows claim.

    ``_corrupt_record`` holds the text of a row with a value of another type than declared, such as aliases that are no
    list; its other values are read.
    """
    rows = read_jsonl(spark, f"{folder}/{LIST_FILES[list_type]}", f"{schemas.WATCHLIST}, _corrupt_record string")
    return rows.where("coalesce(entry_id, entity_name, provider_id) is not null").withColumn(
        "served_as", F.lit(list_type)
    )


def read_watchlists(spark: SparkSession, folder: str) -> DataFrame:
    parts = [read_watchlist(spark, folder, lt) for lt in LIST_FILES]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    """A violation per list file that is not there."""
    rows = []
    for name in LIST_FILES.values():
        try:
            spark.read.schema("value string").text(f"{folder}/{name}").schema  # noqa: B018
        except AnalysisException:
            rows.append(("missing_file", name, "no file for this list"))
    return spark.createDataFrame(rows, schemas.VIOLATION)


def missing_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A violation when there is no manifest to hold the lists against."""
    try:
        spark.read.schema("value string").text(path).schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([("missing_manifest", path.rpartition("/")[2], "nothing says what the lists hold")], schemas.VIOLATION)
    return spark.createDataFrame([], schemas.VIOLATION)


def read_golden(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A golden set with a ``locator`` per row; ``kind`` is normalization, matching or decisions."""
    schema = {
        "normalization": schemas.GOLDEN_NORMALIZATION,
        "matching": schemas.GOLDEN_MATCHING,
        "decisions": schemas.GOLDEN_DECISIONS,
    }[kind]
    rows = read_jsonl(spark, path, schema)
    return rows.withColumn("locator", F.concat(F.lit(f"{kind}.jsonl:"), F.xxhash64(F.to_json(F.struct("*"))).cast("string")))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.WATCHLIST_UPDATE)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(declared counts per list, plant targets)."""
    manifest = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    declared = manifest.select(F.explode("providers").alias("provider_id", "p")).select("provider_id", "p.*")
    return declared, manifest.select(F.explode("plant_targets").alias("entry_id"))


def read_submissions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Submitted profiles, as a batch or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.KYC_SUBMISSION).json(path)


def exact_digest(rows: DataFrame) -> DataFrame:
    """(rows, sha256) over the sorted JSON text, for golden-sized sets; larger ones are refused, not cut."""
    if rows.limit(MAX_EXACT_ROWS + 1).count() > MAX_EXACT_ROWS:
        raise ValueError(f"more than {MAX_EXACT_ROWS} rows: use fingerprint")
    columns = sorted(rows.columns)
    return rows.select(F.to_json(F.struct(*columns)).alias("line")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n")), 256).alias("sha256"),
    )


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, digest) of any size: the sum of one md5-based number per row, so order and partitioning do not matter."""
    columns = sorted(rows.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))
