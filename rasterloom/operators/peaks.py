"""Density profiles along lines and their peaks, by joins between neighbouring lines and rounds of local winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.asof import asof
from rasterloom.operators.focal import reach
from rasterloom.sources.shared import discard, written

#: Lines that one group of a profile's smoothing holds, besides those that it shares with its neighbours.
LINES = 4096


def density(df: DataFrame, flag: Column, smooth: int, h: int, lines: int = LINES) -> DataFrame:
    """r, dens: share of flagged pixels per line, box-smoothed over `smooth` lines with mirrored ends. A line goes to the
    blocks of lines whose windows it is in (one, or two near a block's end), and windows work inside blocks."""
    per = df.groupBy("r").agg(F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("dens"))
    lo, hi = reach(smooth)
    at = F.col("r")
    images = F.filter(F.array(at, F.when(at < lo, -1 - at), F.when(at >= h - hi, 2 * h - 1 - at)), lambda x: x.isNotNull())
    seen = per.select(F.explode(images).alias("r"), "dens")
    blocks = F.sequence(F.floor((F.col("r") - hi) / lines), F.floor((F.col("r") + lo) / lines))
    seen = seen.select("*", F.explode(blocks).alias("block"))
    over = Window.partitionBy("block").orderBy("r").rangeBetween(-lo, hi)
    out = seen.withColumn("dens", F.sum("dens").over(over) / smooth)
    return out.filter((F.col("r") >= 0) & (F.col("r") < h) & (F.floor(F.col("r") / lines) == F.col("block"))).select("r", "dens")


def maxima(profile: DataFrame, height: float) -> DataFrame:
    """Lines above both neighbours; of a flat top, the middle (rounded down). Ends are no peaks. Lines (r, one row each,
    without gaps) meet the line before by a join on their number; where flat runs end is an as-of join on their beginnings."""
    profile = written(profile.select(F.col("r").cast("int").alias("r"), "dens"), "profile")
    before = profile.select((F.col("r") + 1).alias("r"), F.col("dens").alias("last"))
    starts = profile.join(before, "r", "left").filter(F.col("last").isNull() | (F.col("last") != F.col("dens")))
    starts = written(starts.select("r", "dens", "last"), "runs")
    begun = starts.select(F.col("r").cast("double").alias("v"))
    runs = asof(begun, starts.select(F.col("r").cast("double").alias("m"), F.col("r").alias("k"))).select(F.col("k").cast("int").alias("r"), F.col("k2").cast("int").alias("next"))
    after = starts.select(F.col("r").alias("next"), F.col("dens").alias("then"))
    tops = starts.join(runs, "r").join(after, "next").filter((F.col("last") < F.col("dens")) & (F.col("then") < F.col("dens")) & (F.col("dens") >= height))
    return tops.select(F.floor((F.col("r") + F.col("next") - 1) / 2).cast("int").alias("r"), "dens")


def spaced(peaks: DataFrame, distance: int, most: int) -> DataFrame:
    """The tallest first, of peaks at least `distance` lines apart; at most `most`. Of equal heights the later line goes first
    while choosing, and the earlier one where `most` cuts.

    Every round keeps the peaks that are first within their distance among the undecided and drops what lies near them:
    the choice that going through all peaks in order makes. Rounds are written; peaks meet by buckets of lines. It ends when
    nothing is undecided, or nothing that could still be among the `most`."""
    spark = peaks.sparkSession
    left = written(peaks.select(F.col("r").cast("int").alias("r"), F.col("dens").cast("double").alias("dens")).filter("dens is not null"), "peaks")
    kept: DataFrame | None = None
    bucket = lambda x: F.floor(F.col(x) / distance).cast("int")
    rounds = []
    while left.head(1):
        near = left.select(F.col("r").alias("r2"), F.col("dens").alias("dens2"), F.explode(F.array(*[bucket("r") + k for k in (-1, 0, 1)])).alias("b"))
        first = (F.col("dens2") > F.col("dens")) | ((F.col("dens2") == F.col("dens")) & (F.col("r2") > F.col("r")))
        beaten = left.withColumn("b", bucket("r")).join(near, "b").filter(first & (F.abs(F.col("r") - F.col("r2")) < distance)).select("r").distinct()
        won = written(left.join(beaten, "r", "left_anti"), "won")
        kept = won if kept is None else kept.union(won)
        gone = won.select(F.col("r").alias("r2"), F.explode(F.array(*[bucket("r") + k for k in (-1, 0, 1)])).alias("b"))
        gone = left.withColumn("b", bucket("r")).join(gone, "b").filter(F.abs(F.col("r") - F.col("r2")) < distance).select("r").distinct()
        last, left = left, written(left.join(gone, "r", "left_anti"), "peaks")
        rounds.append(won)
        top = left.agg(F.max("dens")).first()[0]
        done = top is None or kept.filter(F.col("dens") > top).limit(most).count() >= most
        discard(last)
        if done:
            break
    if kept is None:
        return spark.createDataFrame([], "r int, dens double")
    return kept.orderBy(F.desc("dens"), "r").limit(most)


def even(h: int, half: int, n: int) -> list[int]:
    """n lines evenly apart from half to h - half, cut to whole numbers."""
    return [int(half + k * ((h - half) - half) / (n - 1)) if n > 1 else half for k in range(n)]


def centres(profile: DataFrame, height: float, distance: int, most: int, h: int, half: int) -> DataFrame:
    """The chosen peaks of a profile, or, where it has none, evenly spaced lines with their heights."""
    found = maxima(profile, height)
    if found.head(1):
        return spaced(found, distance, most)
    lines = profile.sparkSession.createDataFrame([(r,) for r in sorted(set(even(h, half, most)))] if h else [], "r int")
    return lines.join(profile.select("r", "dens"), "r")
