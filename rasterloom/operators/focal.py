"""Neighbourhood operators on dense grids: box windows with mirrored edges, gradients, terrain.

Box sums are taken in tiles: a pixel is shuffled once, and again for each tile whose halo it lies in ((1 + window / TILE)
squared times), and a task sums a tile of all bands by running sums in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.ray_tiles import tiled

TILE = 256


def reach(size: int) -> tuple[int, int]:
    """Cells before and after the centre; an even window has one more before it."""
    return size // 2, size - 1 - size // 2


def _mirrored(first: int, n: int, total: int) -> np.ndarray:
    """Which of the places first .. first + n - 1 stands for each of them: mirrored at the ends of 0 .. total - 1, edge pixels
    twice, as often as it takes."""
    at = (first + np.arange(n)) % (2 * total)
    return np.where(at < total, at, 2 * total - 1 - at) - first


def _running(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums over windows of a size along an axis; the result is shorter by size - 1."""
    upto = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
    n = x.shape[axis] - size + 1
    return np.take(upto, np.arange(size, size + n), axis) - np.take(upto, np.arange(n), axis)


def box_sums(df: DataFrame, columns: list[str], size: tuple[int, int], shape: tuple[int, int], reflect: bool = True, tile: int = TILE) -> DataFrame:
    """r, c and sums of columns over a window of size (rows, columns); NULL counts as absent, a window of nothing gives NULL.
    With reflect, edges are mirrored: a pixel off the grid is that which its distance behind the edge has before it."""
    lo, hi = zip(*map(reach, size))
    halo = tuple(map(max, lo, hi))
    wide = max(tile, *halo)  # mirror images of a tile's halo lie in the tile, or the grid is smaller

    def solve(r, c, top, left, arrays, there):
        cuts = []
        for axis, (first, total) in enumerate(zip((top, left), shape)):
            n = there.shape[axis]
            at = _mirrored(first, n, total) if reflect else np.arange(n)
            inside = (at >= 0) & (at < n)
            cuts.append((np.where(inside, at, 0), inside))
        (rows, on_rows), (cols, on_cols) = cuts
        out = {"r": (r + top).astype(np.int32), "c": (c + left).astype(np.int32)}
        for name in columns:
            x = arrays[name][np.ix_(rows, cols)]
            known = ~np.isnan(x) & on_rows[:, None] & on_cols
            sums = [_running(_running(v, size[0], 0), size[1], 1) for v in (np.where(known, x, 0.0), known.astype(np.float64))]
            value, count = (v[r - lo[0], c - lo[1]] for v in sums)
            out[name] = np.ma.masked_array(value, count < 0.5)
        return out

    schema = ", ".join(["r int", "c int", *(f"{x} double" for x in columns)])
    narrow = df.select("r", "c", *[F.col(x).cast("double").alias(x) for x in columns])
    return tiled(narrow, columns, wide, halo, solve, schema)


def multilook(df: DataFrame, columns: list[str], size: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Box mean with mirrored edges; every value is defined."""
    n = size[0] * size[1]
    return box_sums(df, columns, size, shape).withColumns({c: F.col(c) / n for c in columns})


def multilook_valid(df: DataFrame, column: str, size: tuple[int, int], shape: tuple[int, int], least: float = 0.5) -> DataFrame:
    """Box mean of the valid values; NULL under a valid fraction of `least`. Both passes carry sums, since means
    of means would weigh lines by their gaps."""
    n = size[0] * size[1]
    two = df.select("r", "c", F.coalesce(column, F.lit(0.0)).alias("_s"), F.when(F.col(column).isNotNull(), 1).otherwise(0).cast("double").alias("_k"))
    sums = box_sums(two, ["_s", "_k"], size, shape)
    return sums.select("r", "c", F.when(F.col("_k") / n >= least, F.col("_s") / F.col("_k")).alias(column), (F.col("_k") / n).alias("valid_fraction"))


def gradient(df: DataFrame, column: str = "z", dy: float = 20.0, dx: float = 20.0, tile: int = TILE) -> DataFrame:
    """r, c, column, gy and gx: central differences inside, one-sided at the edges of the grid and 0 on a line of one pixel;
    NULL next to a gap, be it a NULL value or a pixel that has no row."""
    first_r, last_r, first_c, last_c = df.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if first_r is None:
        return df.select("r", "c", column, F.lit(0.0).alias("gy"), F.lit(0.0).alias("gx"))

    def solve(r, c, top, left, arrays, there):
        z = arrays[column]
        v, found = z[r, c], {}
        for name, step, at, ends, before, after in (("gy", dy, r + top, (first_r, last_r), z[r - 1, c], z[r + 1, c]), ("gx", dx, c + left, (first_c, last_c), z[r, c - 1], z[r, c + 1])):
            first, last = at == ends[0], at == ends[1]
            found[name] = np.select([first & last, first, last], [np.zeros(len(v)), (after - v) / step, (v - before) / step], (after - before) / (2 * step))
        told = {"r": (r + top).astype(np.int32), "c": (c + left).astype(np.int32)}
        return told | {n: np.ma.masked_invalid(x) for n, x in ((column, v), *found.items())}

    narrow = df.select("r", "c", F.col(column).cast("double").alias(column))
    return tiled(narrow, [column], tile, (1, 1), solve, f"r int, c int, {column} double, gy double, gx double")


def slope_deg() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))


def aspect_deg() -> Column:
    return F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360, F.lit(360.0))


def hillshade_unit(azimuth: float = 0.0, elevation: float = 1.54) -> Column:
    """Illumination in [0, 1] of a sun at azimuth and elevation."""
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    az, el = F.radians(F.lit(azimuth)), F.radians(F.lit(elevation))
    v = F.sin(el) * F.cos(slope) + F.cos(el) * F.sin(slope) * F.cos(az - aspect)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def hillshade_byte(azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """The 0-255 variant. It takes cosine and sine of the altitude the other way round than hillshade_unit(),
    and measures aspect from the other axis; kept, as results are to match."""
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(-F.col("gy"), F.col("gx"))
    az, al = F.radians(F.lit(360.0 - azimuth + 90.0)), F.radians(F.lit(altitude))
    v = F.cos(al) * F.cos(slope) + F.sin(al) * F.sin(slope) * F.cos(az - aspect)
    return F.least(F.greatest(v * 255, F.lit(0.0)), F.lit(255.0))


def geographic_steps(lat_centre: float, deg_y: float, deg_x: float, radius: float = 1_737_400.0) -> tuple[float, float]:
    """Pixel sizes in metres of a grid in degrees, at its centre latitude."""
    import math

    metre = math.pi / 180 * radius
    return deg_y * metre, deg_x * metre * abs(math.cos(math.radians(lat_centre)))
