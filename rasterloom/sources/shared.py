"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Removes a query's shuffle files once it has ended, not when the driver's collector comes by.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_used: set[str] = set()
_lock = threading.Lock()
#: Writes that go on in each session, and its setting before the first of them.
_writing: dict[SparkSession, tuple[int, str]] = {}


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting holds while some thread writes in the session, and is put back after the last one."""
    with _lock:
        n, before = _writing.get(spark) or (0, spark.conf.get(_CLEAN))
        _writing[spark] = (n + 1, before)
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(spark)
            if n > 1:
                _writing[spark] = (n - 1, before)
            else:
                spark.conf.set(_CLEAN, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, one of our own in local mode,
    which is one machine; elsewhere that is an error, as executors share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "/tmp/checkpoints/rasterloom"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables. What queries have not discarded, since their results read
    it, is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _used:
        _used.add(path)
        atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str, group_bytes: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet and reads it back. Its shuffle files go with the end of the write. group_bytes:
    about what a writer and a reader hold at once of a table of long rows (by default Parquet's 128 MB)."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    with _cleaned(spark):
        df.write.options(**sizes).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that is made of them has been written too."""
    for t in tables:
        if "_written_at" in t.__dict__:
            _remove(t.sparkSession, t._written_at)
