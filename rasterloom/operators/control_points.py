"""Warp by ground control points: polynomials from places to source rows and columns, fitted by least squares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.resample import sampled


def powers(degree: int) -> list[tuple[int, int]]:
    """Exponents of x and y in the terms of a polynomial."""
    return [(n - j, j) for n in range(degree + 1) for j in range(n + 1)]


@dataclass(frozen=True)
class Fit:
    """Row and column as polynomials of x and y, which are first moved and scaled to -1 .. 1 over the control points."""

    degree: int
    middle: tuple[float, float]
    half: tuple[float, float]
    row: tuple[float, ...]
    column: tuple[float, ...]

    def at(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = ((e - m) / s for e, m, s in zip((x, y), self.middle, self.half))
        terms = [_power(u, i) * _power(v, j) for i, j in powers(self.degree)]
        return tuple(sum((F.lit(k) * t for k, t in zip(ks[1:], terms[1:])), F.lit(ks[0])) for ks in (self.row, self.column))


def _power(e: Column, n: int) -> Column:
    out = F.lit(1.0)
    for _ in range(n):
        out = out * e
    return out


def fitted(points: DataFrame, degree: int = 2) -> Fit | None:
    """The polynomials of degree 1 to 3 that miss the control points (r, c, x, y) by the least sum of squares; None without
    points. One aggregation finds the points' extent, one the sums of the normal equations, a few dozen numbers whatever
    the number of points. Points with a NULL take no part; with fewer points than terms the shortest solution is taken."""
    if not 1 <= degree <= 3:
        raise ValueError("the degree is 1, 2 or 3")
    points = points.select(*[F.col(k).cast("double").alias(k) for k in "rcxy"]).dropna()
    e = points.agg(*[f(k).alias(n + k) for k in "xy" for n, f in (("a", F.min), ("b", F.max))]).first()
    if e["ax"] is None:
        return None
    middle = tuple((e["a" + k] + e["b" + k]) / 2 for k in "xy")
    half = tuple(max((e["b" + k] - e["a" + k]) / 2, 1e-9) for k in "xy")
    u, v = ((F.col(k) - m) / s for k, m, s in zip("xy", middle, half))
    terms = powers(degree)
    moments = [F.sum(_power(u, i) * _power(v, j)).alias(f"m{i}_{j}") for i, j in powers(2 * degree)]
    told = [F.sum(_power(u, i) * _power(v, j) * F.col(k)).alias(f"{k}{i}_{j}") for k in "rc" for i, j in terms]
    s = points.agg(*moments, *told).first()
    normal = np.array([[s[f"m{a + i}_{b + j}"] for i, j in terms] for a, b in terms])
    rows, columns = (np.linalg.lstsq(normal, np.array([s[f"{k}{i}_{j}"] for i, j in terms]), rcond=None)[0] for k in "rc")
    return Fit(degree, middle, half, tuple(map(float, rows)), tuple(map(float, columns)))


def residuals(points: DataFrame, fit: Fit) -> DataFrame:
    """points with dr and dc, what the fit says less what they are, and miss, the distance in pixels."""
    r, c = fit.at(F.col("x"), F.col("y"))
    out = points.withColumns({"dr": r - F.col("r"), "dc": c - F.col("c")})
    return out.withColumn("miss", F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))


def warped(src: DataFrame, target: DataFrame, column: str, fit: Fit, h: int, w: int) -> DataFrame:
    """target (r, c, x, y) with column of src (r, c), read bilinearly where the fit says; NULL outside of the source."""
    fr, fc = fit.at(F.col("x"), F.col("y"))
    return sampled(target.select("r", "c", "x", "y"), src.select("r", "c", column), column, fr, fc, h, w).select("r", "c", column)
