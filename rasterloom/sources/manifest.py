"""Products that are made once: a manifest beside each says what it was made of, and a second run reads what is there.

The fingerprint covers the optimised plan (operations and their parameters), further parameters, and name, length and time of
every input file. The manifest is written after the data, so that what a broken run left is made again; each attempt writes
to a folder of its own, and readers follow the manifest, never a folder that is still being written."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, length and time of the files that a table reads."""
    out = []
    for name in sorted(df.inputFiles()):
        fs, at = _fs(spark, name)
        s = fs.getFileStatus(at)
        out.append((name, s.getLen(), s.getModificationTime()))
    return out


def fingerprint(df: DataFrame, parameters: dict | None = None) -> str:
    """Changes with the operations, their parameters, and the input files; not from run to run."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    numbers: dict[str, str] = {}  # columns are numbered anew in each run; here in the order in which they appear
    plan = re.sub(r"#\d+L?", lambda m: numbers.setdefault(m[0].rstrip("L"), f"#{len(numbers)}"), plan)
    told = json.dumps([plan, parameters or {}, files_of(df.sparkSession, df)], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def made_once(df: DataFrame, path: str, parameters: dict | None = None, force: bool = False, write: Callable[[DataFrame, str], None] | None = None, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """df from where it was written before, if it was made of the same plan, parameters and files; else written now.

    path: a folder of the product. write and read take another format than Parquet. What an older manifest named is removed
    once the new one stands. force makes it again."""
    spark = df.sparkSession
    write = write or (lambda table, at: table.write.parquet(at))
    read = read or (lambda s, at: s.read.parquet(at))
    mark, known = fingerprint(df, parameters), _read(spark, path)
    if known and known["fingerprint"] == mark and not force:
        return read(spark, f"{path}/{known['folder']}")
    folder = f"made-{uuid.uuid4().hex}"
    write(df, f"{path}/{folder}")
    fs, at = _fs(spark, f"{path}/_manifest.json")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps({"fingerprint": mark, "folder": folder, "parameters": parameters or {}}, default=str).encode()))
    finally:
        stream.close()
    if known:
        old, at = _fs(spark, f"{path}/{known['folder']}")
        old.delete(at, True)
    return read(spark, f"{path}/{folder}")
