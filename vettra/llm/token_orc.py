"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of ``doc_id`` and sorted within each range, so files hold ascending, disjoint ranges of ids
(equal ids share a file). ORC stores the id arrays run-length encoded in stripes; stripes are read in parallel, and the
row indexes and Bloom filters let a reader skip what cannot hold a wanted document.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import arrow_map, columns, stored, texts
from vettra.llm.library_encoder import encoder

SCHEMA = "doc_id bigint, n_tokens int, ids array<int>"

WRITING = {
    "compression": "lz4",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``SCHEMA`` rows in the order of ``docs``; each document ends with ``end_id`` (null and empty texts: only that)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch):
        import pyarrow as pa

        tool = encoder(tokenizer)
        made = [tool.encode(t) + end for t in texts(batch)]
        lengths = np.array([len(x) // 4 for x in made], "int32")
        starts = np.concatenate([[0], np.cumsum(lengths, dtype="int64")])
        ids = pa.array(np.frombuffer(b"".join(made), "<i4"))
        lists = pa.ListArray.from_arrays(pa.array(starts.astype("int32")), ids)
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(lengths), "ids": lists}

    return arrow_map(docs, SCHEMA, run)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encode ``text`` of every row of (doc_id, text) and write the ids in ascending order of ``doc_id``.

    Nulls in ``doc_id`` come first. Repeated rows are written as often as they come. An empty table gives a folder
    without rows.
    """
    rows = columns(docs, doc_id="bigint", text="string")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    encoded(ordered, tokenizer, end_id).write.options(**WRITING).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; filters on ``doc_id`` reach the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; files, stripes and row groups without them are skipped by their metadata."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def located(rows: DataFrame) -> DataFrame:
    """Each document's place in the id stream, from the files: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it; among rows of equal ``doc_id`` the order is by length and
    checksum. Only counts are shuffled: sums by file, then sums within a file.
    """

    def run(batch):
        lists = batch.column("ids")
        at = np.asarray(lists.offsets)
        ids = np.ascontiguousarray(np.asarray(lists.values), "<i4")
        return {
            "doc_id": batch.column("doc_id"),
            "file": batch.column("file"),
            "n_tokens": np.diff(at).astype("int64"),
            "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)],
        }

    files = rows.select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))
    counted = arrow_map(files, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint", run)
    counted = stored(counted, "token-places")  # read twice below, and small
    first = F.col("doc_id").asc_nulls_first()
    sums = counted.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("doc_id"))
    before_file = F.sum("total").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("file", F.coalesce(before_file, F.lit(0)).alias("before"))
    order = Window.partitionBy("file").orderBy(first, "n_tokens", "ids_crc32")
    inside = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("inside", inside).join(sums, "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
