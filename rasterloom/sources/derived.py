"""Grids derived from the driver's tables: every band is a table of pixels (r, c) with double columns.

A vector of `embeddings` is a raster line: r = vec_id, c = position. Further bands are the same line read at
other offsets, modulo its length, so that no join is needed to make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.validity import canonical
from rasterloom.sources.rasters import Frame

WIDTH = 64
#: The grids' place on the polar plane; bands of another product come without a coordinate system.
FRAME = Frame("moon south polar stereographic", -640.0, 0.0, 20.0)
BARE = Frame("", -640.0, 0.0, 20.0, -9999.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """r, c, v. A window (both ends included) is cut before lines become pixels: rows reach the Parquet scan as
    a filter on the stored number, columns are sliced out of the line."""
    e = table(spark, sf_dir, "embeddings")
    if rows:
        e = e.filter(F.col("vec_id").between(*rows))
    first, line = 0, F.col("embedding")
    if columns:
        first, line = columns[0], F.slice("embedding", columns[0] + 1, columns[1] - columns[0] + 1)
    out = e.select(F.col("vec_id").cast("int").alias("r"), F.posexplode(line).alias("c", "v"))
    return out.select("r", (F.col("c") + first).cast("int").alias("c"), canonical(F.col("v"), None).alias("v"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c and the whole line e, for bands that read at offsets."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("r"), F.col("embedding").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("c"))


def at(k: int) -> Column:
    return F.get(F.col("e"), (F.col("c") + k) % WIDTH).cast("double")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation in metres, from kilometres."""
    return grid(spark, sf_dir).select("r", "c", (F.col("v") * 4 * 1000).alias("z"))


def shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dem with psr, 1 where permanently shadowed."""
    return grid(spark, sf_dir).select("r", "c", (F.col("v") * 4 * 1000).alias("z"), F.when(F.col("v") < 0.1, 1).otherwise(0).alias("psr"))


def sli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four complex channels."""
    pairs = {"hh": (0, 16), "hv": (32, 48), "vh": (8, 24), "vv": (40, 56)}
    return lines(spark, sf_dir).select("r", "c", *[at(k).alias(f"{p}_{x}") for p, ks in pairs.items() for x, k in zip(("re", "im"), ks)])


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six continuous bands and two masks, some values missing, and an official product."""
    null_over = lambda v, k, most: F.when(at(k) <= most, v)
    return lines(spark, sf_dir).select(
        "r", "c",
        null_over(0.4 + 2 * at(0), 5, 0.2).alias("cpr"), null_over(F.abs(at(8)) * 2, 9, 0.15).alias("dop"),
        null_over(110 + 300 * at(16), 17, 0.25).alias("tmean"), (1 + 5 * F.abs(at(24))).alias("zit"),
        null_over(10 * at(32) * at(32), 33, 0.1).alias("pump"), (40 * F.abs(at(40))).alias("slope"),
        F.when(at(48) < -0.05, 1.0).otherwise(0.0).alias("psr"), F.when(at(48) < -0.15, 1.0).otherwise(0.0).alias("dpsr"),
        null_over(0.5 + 1.6 * at(0) + 0.6 * at(56), 57, 0.2).alias("official"),
    )


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw digital numbers of four channels, one row per order line; lid keeps repeated keys apart."""
    li = table(spark, sf_dir, "lineitem")
    whole = lambda x: F.floor(x + 0.5).cast("double")
    return li.select(
        F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("l_partkey").alias("lid"),
        whole(F.col("l_quantity") * 10 - 100).alias("hh"), whole(F.col("l_discount") * 1000).alias("hv"),
        whole(F.col("l_tax") * 1000).alias("vh"), whole(F.col("l_extendedprice") / 100).alias("vv"),
    )


TIE_COLUMNS = 9


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie points in file order: n, slant range (resets every TIE_COLUMNS points), lat, lon."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("n"), (n % TIE_COLUMNS * 200 + 0.1 * F.col("value")).alias("slant"),
        (-90 + F.col("value") / 50).alias("lat"), (F.col("user_id") * 2.4 - 180).alias("lon"),
    )


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calc and official over pixels where both are comparable."""
    from rasterloom.functions.validity import comparable

    b = bands(spark, sf_dir)
    return b.select("r", "c", F.col("cpr").alias("a"), F.col("official").alias("b")).filter(comparable(F.col("a"), F.col("b")))
