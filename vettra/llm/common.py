"""Helpers that the operators share: typed inputs, Arrow maps, a bounded memo, union of links into components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.session import shared_folder, stored

__all__ = ["Memo", "arrow_map", "columns", "new_folder", "packed", "stored", "texts", "unpacked"]


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns never reach an operator, so their names cannot clash with its own."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()])


def packed(docs: DataFrame) -> DataFrame:
    """(rest, text): the text, and all other columns in one struct, so that names of added columns cannot clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("rest"), F.col("text").cast("string").alias("text"))


def unpacked(rows: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs`` again; ``n_chars``, if there, is counted anew in the rows where ``changed`` holds."""

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        old = F.col(f"rest.`{name}`")
        if name != "n_chars":
            return old.alias(name)
        return F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)

    return rows.select(*[column(c) for c in docs.columns])


def new_folder(spark, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow_map(df: DataFrame, schema: str | T.StructType, rows: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """Replace each Arrow batch by the columns that ``rows`` makes of it."""
    spark_type = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_type)
        for batch in batches:
            made = rows(batch)
            arrays = [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, spark_type)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The values of a text column, one at a time (never a list of all texts of the batch)."""
    return (x.as_py() for x in batch.column(name))


class Memo(dict):
    """Values by key, made on first use; at most two generations of ``size`` entries, so that frequent keys stay.

    Keys for which ``keep`` is false are made anew each time.
    """

    def __init__(self, make: Callable, size: int, keep: Callable = lambda key: True):
        super().__init__()
        self.make, self.size, self.keep, self.old = make, size, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if not self.keep(key):
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
