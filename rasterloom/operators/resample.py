"""Tie points and resampling between grids. A sample is an equi-join on source pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geodesy
from rasterloom.operators.asof import asof
from rasterloom.sources.rasters import Frame

def tie_group(ties: DataFrame, drop: float = -500.0) -> DataFrame:
    """One row: n_rng, the points before the range first falls by more than -drop, and n_az. The difference to
    the point before is a self-join on the file position, so that no window orders the whole file."""
    nxt = ties.select((F.col("n") - 1).alias("n"), F.col("slant").alias("next"))
    fall = ties.join(nxt, "n").filter(F.col("next") - F.col("slant") < drop).agg((F.min("n") + 1).alias("n_rng"))
    return fall.crossJoin(ties.agg(F.count(F.lit(1)).alias("total"))).select("n_rng", F.floor(F.col("total") / F.col("n_rng")).alias("n_az"), "total")


def tie_grid(ties: DataFrame, n_rng: int, n_az: int, h: int, w: int) -> DataFrame:
    """i, j, lat, lon and the pixel position of every tie point, spaced evenly over the scene."""
    g = ties.select(F.floor(F.col("n") / n_rng).cast("int").alias("i"), (F.col("n") % n_rng).cast("int").alias("j"), "lat", "lon").filter(F.col("i") < n_az)
    even = lambda k, n, m: F.col(k).cast("long") * (n - 1) / (m - 1)
    return g.select("i", "j", "lat", "lon", even("i", h, n_az).alias("row_px"), even("j", w, n_rng).alias("col_px"))


def control_points(grid: DataFrame, every: int = 10) -> DataFrame:
    return grid.filter((F.col("i") % every == 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))


def cells(grid: DataFrame, columns: list[str]) -> DataFrame:
    """i, j and the four corners of each cell (<column>00, 01, 10, 11), from two window steps."""
    right, down = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    one = grid.select("i", "j", *[x for c in columns for x in (F.col(c).alias(f"{c}00"), F.lead(c).over(right).alias(f"{c}01"))])
    return one.select("*", *[x for c in columns for x in (F.lead(f"{c}00").over(down).alias(f"{c}10"), F.lead(f"{c}01").over(down).alias(f"{c}11"))])


def interpolate(points: DataFrame, grid: DataFrame, columns: list[str], fi: Column, fj: Column, ni: int, nj: int) -> DataFrame:
    """Bilinear values of columns at fractional grid positions; extrapolates from the outermost cells."""
    i = F.least(F.greatest(F.floor(fi), F.lit(0)), F.lit(ni - 2)).cast("int")
    j = F.least(F.greatest(F.floor(fj), F.lit(0)), F.lit(nj - 2)).cast("int")
    p = points.withColumns({"_fi": fi, "_fj": fj, "i": i, "j": j})
    p = p.join(cells(grid, columns), ["i", "j"])
    u, v = F.col("_fi") - F.col("i"), F.col("_fj") - F.col("j")
    mix = lambda c: F.col(f"{c}00") * (1 - u) * (1 - v) + F.col(f"{c}01") * (1 - u) * v + F.col(f"{c}10") * u * (1 - v) + F.col(f"{c}11") * u * v
    return p.select(*points.columns, *[mix(c).alias(c) for c in columns])


def sampled(points: DataFrame, src: DataFrame, column: str, fr: Column, fc: Column, h: int, w: int, most_invalid: float = 0.5, gap: float = 0.0) -> DataFrame:
    """points with column, read bilinearly from src (r, c) at fractional rows and columns. Gaps count as `gap` and
    as invalid; NULL outside of the source, or where the invalid weight is over most_invalid. One join and one
    aggregation; equal points, whose values are equal, are counted and given back as often."""
    p = points.withColumns({"_fr": fr, "_fc": fc})
    p = p.withColumns({"_r": F.floor("_fr").cast("int"), "_c": F.floor("_fc").cast("int")})
    inside = (F.col("_fr") >= 0) & (F.col("_fr") <= h - 1) & (F.col("_fc") >= 0) & (F.col("_fc") <= w - 1)
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("_k")
    part = lambda f, i, k: F.when(F.col(k) == 1, F.col(f) - F.col(i)).otherwise(1 - (F.col(f) - F.col(i)))
    weight = F.when(inside, part("_fr", "_r", "_k.a") * part("_fc", "_c", "_k.b"))
    e = p.select("*", corners).select(
        *points.columns, weight.alias("_w"), ((F.col("_k.a") == 0) & (F.col("_k.b") == 0)).alias("_own"),
        (F.col("_r") + F.col("_k.a")).alias("_sr"), (F.col("_c") + F.col("_k.b")).alias("_sc"),
    )
    s = src.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(column).alias("_v"))
    got = e.filter((F.col("_w") > 0) | F.col("_own")).join(s, ["_sr", "_sc"], "left").groupBy(*points.columns).agg(
        F.sum(F.col("_w") * F.coalesce("_v", F.lit(gap))).alias("_sum"), F.sum(F.when(F.col("_v").isNull(), F.col("_w")).otherwise(0.0)).alias("_bad"),
        F.count_if(F.col("_own")).alias("_n"), F.count("_w").alias("_in"),
    )
    value = F.when((F.col("_in") > 0) & (F.col("_bad") / F.col("_n") <= most_invalid), F.col("_sum") / F.col("_n"))
    return got.select(*points.columns, value.alias(column), F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_again")).drop("_again")


def nearest(points: DataFrame, src: DataFrame, column: str, r: Column, c: Column) -> DataFrame:
    """points with column of the pixel (r, c); NULL where there is none."""
    p = points.withColumns({"_sr": r, "_sc": c})
    return p.join(src.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), column), ["_sr", "_sc"], "left").drop("_sr", "_sc")


def blended(points: DataFrame, src: DataFrame, column: str, fr: Column, fc: Column, h: int, w: int) -> DataFrame:
    """points with column, bilinear at fractional pixel centres of src (r, c). The weight of a pixel that is missing,
    NULL or over the edge goes to the others; NULL outside of the source's edges and where no pixel is left. One
    join and one aggregation; equal points are counted and given back as often."""
    p = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_fr": fr, "_fc": fc})
    p = p.withColumns({"_r": F.floor("_fr").cast("int"), "_c": F.floor("_fc").cast("int")})
    inside = F.col("_fr").between(-0.5, h - 0.5) & F.col("_fc").between(-0.5, w - 0.5)
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("_k")
    part = lambda f, i, k: F.when(F.col(k) == 1, F.col(f) - F.col(i)).otherwise(1 - (F.col(f) - F.col(i)))
    e = p.select("*", corners).withColumns({
        "_w": F.when(inside, part("_fr", "_r", "_k.a") * part("_fc", "_c", "_k.b")), "_sr": F.col("_r") + F.col("_k.a"), "_sc": F.col("_c") + F.col("_k.b"),
    })
    s = src.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(column).alias("_v"))
    weight = F.when(F.col("_v").isNotNull() & (F.col("_w") > 0), F.col("_w"))
    got = e.join(s, ["_sr", "_sc"], "left").groupBy(*points.columns, "_n").agg((F.sum(weight * F.col("_v")) / F.sum(weight)).alias("_value"))
    return got.select(*points.columns, F.col("_value").alias(column), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_again")).drop("_again")


def aligned(target: DataFrame, src: DataFrame, column: str, frame: Frame, shape: tuple[int, int], scale: float = 1.0, masks: bool = False, across: float | None = None) -> DataFrame:
    """target (r, c and x, y on the polar plane) with column of src in the frame's place, times scale: bilinear, or the
    nearest pixel for masks. A frame without a coordinate system is taken as latitude and longitude on the sphere,
    rows northwards from its top, columns `across` degrees apart (its step by default)."""
    if frame.crs:
        fr, fc = (frame.top - F.col("y")) / frame.step, (F.col("x") - frame.left) / frame.step
    else:
        lat, lon = geodesy.from_plane(F.col("x"), F.col("y"))
        fr, fc = (lat - frame.top) / frame.step, (lon - frame.left) / (across or frame.step)
    scaled = src.select("r", "c", (F.col(column) * scale).alias(column))
    if masks:
        return nearest(target, scaled, column, F.floor(fr).cast("int"), F.floor(fc).cast("int"))
    return blended(target, scaled, column, fr - 0.5, fc - 0.5, *shape)


def filled_or(forward: DataFrame, cells: int, fallback: Callable[[], DataFrame], least: float = 0.005) -> DataFrame:
    """forward (a row per filled cell), or the fallback's result where it fills less than that share of the target's cells."""
    return forward if forward.count() >= least * cells else fallback()


def resized(patch: DataFrame, column: str, shape: tuple[int, int], size: int, most_invalid: float = 0.4) -> DataFrame:
    """A patch (r, c from 0) stretched to size x size, corners on corners; gaps count as the patch's mean and
    as invalid, NULL where their weight is over most_invalid. Without pixels there is nothing to stretch."""
    h, w = shape
    spark = patch.sparkSession
    mean = patch.agg(F.avg(column)).first()[0]
    if mean is None:
        return patch.select("r", "c", column).limit(0)
    side = spark.range(size)
    p = side.select(F.col("id").cast("int").alias("r")).crossJoin(side.select(F.col("id").cast("int").alias("c")))
    fr, fc = F.col("r") * (h - 1) / float(size - 1), F.col("c") * (w - 1) / float(size - 1)
    return sampled(p, patch, column, fr, fc, h, w, most_invalid, float(mean))


def inverse(asked: DataFrame, value: str, src: DataFrame, line: str) -> DataFrame:
    """value, with the fractional line of src (0, 1, ... in its column `line`) whose mean of `value` it is: means are sorted,
    and their lines interpolated between neighbours. No row outside of the means."""
    means = src.groupBy(F.col(line).alias("k")).agg(F.avg(value).alias("m"))
    found = asof(asked.select(F.col(value).cast("double").alias("v")).distinct(), means).filter("k is not null and k2 is not null")
    at = F.col("k") + (F.col("v") - F.col("m")) / (F.col("m2") - F.col("m")) * (F.col("k2") - F.col("k"))
    return found.select(F.col("v").alias(value), at.alias(f"_{line}"))


def separable_warp(src: DataFrame, target: DataFrame, column: str, h: int, w: int) -> DataFrame:
    """Inverse mapping whose rows and columns are independent: the mean y of each source row and the mean x of
    each source column are inverted by linear interpolation, and the source is read bilinearly there. src has
    r, c, x, y and column; target has r, c, x, y. Pixels outside of the means are left out."""
    t = target.select("r", "c", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = t.join(inverse(t, "y", src, "r"), "y").join(inverse(t, "x", src, "c"), "x").select("r", "c", F.col("_r").alias("fr"), F.col("_c").alias("fc"))
    return sampled(p, src.select("r", "c", column), column, F.col("fr"), F.col("fc"), h, w).select("r", "c", column)
