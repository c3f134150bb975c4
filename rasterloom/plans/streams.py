"""Queries over tiles as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.plans.base import q6, query, r6, sql
from rasterloom.sources import derived
from rasterloom.sources.shared import run_dir
from rasterloom.streaming import tiles

c = F.col


@query("B29_confidence_streamed", sql("scored", f"SELECT r, c, {q6('score')} AS score, n_valid FROM scored"))
def b29_streamed(spark, d):
    """The score of a scene whose lines arrive in two deliveries, each scored when it is there: what a batch over all gives."""
    path = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    bands = derived.bands(spark, d)
    limits = tiles.fixed_limits(bands)
    for half in (0, 1):  # even lines first
        bands.filter(c("r") % 2 == half).write.mode("append").parquet(f"{path}/in")
        tiles.arrive(tiles.stream(spark, f"{path}/in", bands.schema, limits), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("r", "c", r6("score").alias("score"), "n_valid")
