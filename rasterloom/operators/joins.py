"""Joins that grids imply: aligned bands, offsets, samples, circles, nearest points."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources.shared import run_dir

KEYS = ["r", "c"]


def aligned(bands: list[DataFrame], how: str = "inner") -> DataFrame:
    """Bands of one grid side by side. All joins share the pixel key, so that each band is shuffled once."""
    return reduce(lambda a, b: a.join(b, KEYS, how), bands)


def bucketed(df: DataFrame, what: str, buckets: int) -> DataFrame:
    """df, written in buckets by pixel: tables that are bucketed alike meet on the pixel without a shuffle. Each bucket is one
    file, sorted. The table's files lie in the folder of the application, its entry in the session's catalogue."""
    name = f"{what}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS)
    rows.format("parquet").option("path", f"{run_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def offset_pairs(df: DataFrame, other: DataFrame, reach: int, include_self: bool = True) -> DataFrame:
    """df's pixels with those of other within reach rows and columns (tr, tc): a table of offsets is exploded
    on df and the rest is an equi-join, so that no range join compares all pixels."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    e = df.select("*", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    if not include_self:
        e = e.filter((F.col("dr") != 0) | (F.col("dc") != 0))
    e = e.withColumns({"tr": F.col("r") + F.col("dr"), "tc": F.col("c") + F.col("dc")})
    seen = other.select(*[F.col(x).alias({"r": "tr", "c": "tc"}.get(x, f"t_{x}")) for x in other.columns])
    return e.join(seen, ["tr", "tc"])


def within(grid: DataFrame, target: Column, radius: int) -> DataFrame:
    """grid, a row for every pixel, with within: whether a target lies in a circle of radius pixels around it. The
    nearest target of a pixel's own column says how far along the line that column reaches; a pixel is within if
    the reach of some column of its line covers it. Four running windows, whatever the radius."""
    column, line, first = Window.partitionBy("c"), Window.partitionBy("r"), Window.unboundedPreceding
    down, up, right, left = (w.orderBy(k).rowsBetween(first, 0) for w, k in ((column, "r"), (column, F.desc("r")), (line, "c"), (line, F.desc("c"))))
    at = F.when(target, F.col("r"))
    g = grid.withColumns({"_u": F.max(at).over(down), "_d": F.min(at).over(up)})
    g = g.withColumn("_g", F.least(F.col("r") - F.col("_u"), F.col("_d") - F.col("r")).cast("long"))
    g = g.withColumn("_w", F.when(F.col("_g") <= radius, F.floor(F.sqrt(radius * radius - F.col("_g") * F.col("_g")))))
    before = F.max(F.col("c") + F.col("_w")).over(right) >= F.col("c")
    after = F.min(F.col("c") - F.col("_w")).over(left) <= F.col("c")
    return g.withColumn("within", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).drop("_u", "_d", "_g", "_w")


def in_circles(df: DataFrame, circles: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels in circles (name, r0, c0, radius). Circles are dealt to the tiles that their boxes touch and meet the
    pixels by tile, so that any number of circles is an equi-join, which Spark broadcasts where it is small."""
    part = lambda x: F.floor(x / tile).cast("int")
    span = lambda x: F.explode(F.sequence(part(F.col(x) - F.col("radius")), part(F.col(x) + F.col("radius"))))
    dealt = circles.select("*", span("r0").alias("_tr")).select("*", span("c0").alias("_tc"))
    dr, dc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    tiled = df.withColumns({"_tr": part(F.col("r")), "_tc": part(F.col("c"))})
    return tiled.join(dealt, ["_tr", "_tc"]).filter(dr * dr + dc * dc <= F.col("radius") * F.col("radius")).drop("_tr", "_tc")


def nearest_by(df: DataFrame, keys: list[str], distance: Column, order: list[str]) -> DataFrame:
    """For each key the row of the least distance; ties go to the first in order. One partial aggregation."""
    value = F.struct(*[c for c in df.columns if c not in keys], distance.alias("distance"))
    best = df.groupBy(*keys).agg(F.min_by(value, F.struct(distance.alias("d"), *order)).alias("_b"))
    return best.select(*keys, "_b.*")
