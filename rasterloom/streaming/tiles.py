"""Scoring tiles as they arrive: the confidence score as a stateless stream over a folder of pixel tables.

The stretch limits belong to the whole scene, so they come from a batch pass (one row) and stay fixed while
tiles stream in; a tile that is read again gives the same scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.config import INVERTED, MASKS, WEIGHTS
from rasterloom.functions.scaling import limits, mask01, score, stretch


def fixed_limits(bands: DataFrame) -> dict[str, tuple[float, float]]:
    """The percentiles of the continuous bands: one row, whatever the size of the scene."""
    names = [b for b in WEIGHTS if b not in MASKS]
    row = limits(bands, names).first()
    return {b: (row[f"{b}_lo"], row[f"{b}_hi"]) for b in names}


def scored(bands: DataFrame, lim: dict[str, tuple[float, float]]) -> DataFrame:
    """bands with score and n_valid; only projections, so that it runs on a batch and on a stream alike."""
    out = {b: stretch(F.col(b), F.lit(lo), F.lit(hi), 0.5, b in INVERTED) for b, (lo, hi) in lim.items()}
    out |= {b: mask01(F.col(b)) for b in MASKS}
    value, n = score()
    return bands.withColumns(out).withColumn("score", value).withColumn("n_valid", n)


def stream(spark: SparkSession, folder: str, schema: StructType, lim: dict[str, tuple[float, float]], files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of scored pixels from Parquet tiles that appear under folder."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return scored(raw, lim)


def keep(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to the folder of its number, in place of what an attempt before left there: a batch that runs again after
    a failure adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def arrive(scores: DataFrame, out: str, checkpoint: str) -> None:
    """Scores what has arrived since the checkpoint and ends."""
    query = scores.writeStream.foreachBatch(keep(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
