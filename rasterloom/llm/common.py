"""Pieces that the training-data operators share: table reading, Arrow batches, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import shared
from rasterloom.sources.shared import discard  # noqa: F401

#: Rows and bytes of one Arrow batch; a batch of long texts must still fit a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

#: ASCII white space, the separators of words in the quality and join operators.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(spark: SparkSession, df: DataFrame, what: str, group_bytes: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    return shared.written(df, what, group_bytes)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: a worker outlives its task, and
    what it holds counts against its executor while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slim(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of batches that releases memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def plain_names(stage: Callable) -> Callable:
    """A pipeline stage that sees documents whose further columns have neutral names, so that none can clash
    with its own; the names are put back on what it returns, by position."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = [c if c in ("doc_id", "text", "n_chars") else f"extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*neutral), sf_dir).toDF(*docs.columns)

    return run


def map_texts(
    df: DataFrame, row: Callable[[object, str | None], tuple], schema: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One output row for each row of df: row(key, text) gives its columns but the key."""
    spark = df.sparkSession
    bounded_batches(spark)
    key_type = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows = [row(k, t) for k, t in zip(keys.to_pylist(), texts)]
            if not rows:
                continue
            columns = list(zip(*rows))
            if kinds is None:
                kinds = arrow_types(schema)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], [key, *[n for n, _ in kinds]])

    return narrow.mapInArrow(slim(run), f"{key} {key_type}, {schema}")


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[t]) for n, t in (x.strip().split(" ", 1) for x in schema.split(","))]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
