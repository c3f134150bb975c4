"""Ray tables as arrays, and statistics of whole rays by tiles with a halo.

looks() asks for every step of every ray, so that no step can be passed over: a pixel is shuffled once per tile whose
halo it lies in ((1 + 2 reach / tile) squared times for a square tile, whatever the number of azimuths), and each tile
steps all of its observers along a ray at once in arrays. A task holds one tile and its halo: (tile + 2 reach) values
each way, a bound that the caller sets. What rays see or what hides a sun is for ray_pyramid.py, which needs no halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.config import SETTINGS

#: azimuth -> (row offsets, column offsets, distances), each an array over steps
Table = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def bresenham_table(n_angles: int, max_steps: int, cell: float = SETTINGS.cell_m) -> Table:
    """The rays of rays.bresenham_rays(), as arrays."""
    out = []
    for a in range(n_angles):
        rad = a * (2 * math.pi) / n_angles
        er, ec = round(max_steps * math.sin(rad)), round(max_steps * math.cos(rad))
        long, short = max(abs(er), abs(ec)), min(abs(er), abs(ec))
        k = np.arange(1, long + 1)
        minor = (2 * k * short + long) // (2 * long)
        dr, dc = (minor, k) if abs(ec) >= abs(er) else (k, minor)
        dr, dc = dr * (1 if er >= 0 else -1), dc * (1 if ec >= 0 else -1)
        out.append((dr, dc, np.maximum(np.sqrt(dr * dr + dc * dc) * cell, 1.0)))
    return out


def sun_table(azimuths: list[float], max_steps: int, cell: float = SETTINGS.cell_m) -> Table:
    out = []
    k = np.arange(1, max_steps + 1)
    for az in azimuths:
        rad = math.radians(az)
        dr, dc = np.rint(-math.cos(rad) * k).astype(int), np.rint(math.sin(rad) * k).astype(int)
        out.append((dr, dc, np.maximum(np.sqrt(dr * dr + dc * dc) * cell, 1.0)))
    return out


def rounded_table(n_angles: int, max_steps: int, cell: float = SETTINGS.cell_m) -> Table:
    """The rays of rays.rounded_rays(), as arrays."""
    out = []
    k = np.arange(1, max_steps + 1)
    for a in range(n_angles):
        rad = a * (2 * 3.141592653589793) / n_angles
        dr, dc = np.rint(math.sin(rad) * k).astype(int), np.rint(math.cos(rad) * k).astype(int)
        out.append((dr, dc, np.maximum(np.sqrt(dr * dr + dc * dc) * cell, 1.0)))
    return out


def inside(table: Table, h: int, w: int) -> Table:
    """The steps that can land on a grid of h x w: a ray is monotone in both axes, so that this loses no pixel."""
    on = [(abs(dr) < h) & (abs(dc) < w) for dr, dc, _ in table]
    return [(dr[k], dc[k], dist[k]) for (dr, dc, dist), k in zip(table, on)]


def reach(table: Table) -> tuple[int, int]:
    """Rows and columns that the longest rays span."""
    return tuple(max((int(abs(ray[axis]).max()) for ray in table if len(ray[0])), default=0) for axis in (0, 1))


def tiled(grid: DataFrame, columns: list[str], tile: int, halo: tuple[int, int], solve: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Runs solve(r, c, top, left, arrays, there) on every tile: r and c place its pixels in arrays, which are the
    columns over tile and halo (NaN without a pixel, `there` says where one is), cornered at row top, column left."""
    hr, hc = halo
    near = lambda x, n: F.sequence(F.floor((F.col(x) - n) / tile).cast("int"), F.floor((F.col(x) + n) / tile).cast("int"))
    e = grid.select("r", "c", *columns).select("*", F.explode(near("r", hr)).alias("tr")).select("*", F.explode(near("c", hc)).alias("tc"))
    arrow = {"int": pa.int32(), "double": pa.float64()}
    kinds = [(n, arrow[t]) for n, t in (x.strip().split(" ") for x in schema.split(","))]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        r, c = group.column("r").to_numpy(), group.column("c").to_numpy()
        r0, c0 = tr * tile, tc * tile
        own = (r >= r0) & (r < r0 + tile) & (c >= c0) & (c < c0 + tile)
        if not own.any():  # a tile outside of the grid
            return pa.table({n: pa.array([], t) for n, t in kinds})
        top, left = r0 - hr, c0 - hc
        arrays = {}
        for name in columns:
            x = np.full((tile + 2 * hr, tile + 2 * hc), np.nan)
            x[r - top, c - left] = group.column(name).to_numpy(zero_copy_only=False)
            arrays[name] = x
        there = np.zeros((tile + 2 * hr, tile + 2 * hc), bool)
        there[r - top, c - left] = True
        found = solve(r[own] - top, c[own] - left, top, left, arrays, there)
        return pa.table({n: pa.array(np.ma.getdata(found[n]), t, mask=np.ma.getmaskarray(found[n]) if np.ma.isMA(found[n]) else None) for n, t in kinds})

    return e.groupBy("tr", "tc").applyInArrow(run, schema)


def looks(shadow: DataFrame, table: Table, tile: int = 512) -> DataFrame:
    """a, k, n, rise: over each step of each ray the shadowed pixels that meet a pixel there, and by how much those
    pixels lie higher in sum."""
    halo = reach(table)

    def solve(r, c, top, left, arrays, there):
        z, psr = arrays["z"], arrays["psr"]
        shadowed = psr[r, c] == 1
        r, c = r[shadowed], c[shadowed]
        out = []
        for a, (dr, dc, _) in enumerate(table):
            at = np.arange(len(r))
            for k, (i, j) in enumerate(zip(dr, dc), 1):
                y, x = r[at] + i, c[at] + j
                on = there[y, x]
                at, y, x = at[on], y[on], x[on]
                if not len(at):
                    break
                out.append((a, k, len(at), float((z[y, x] - z[r[at], c[at]]).sum())))
        return dict(zip(("a", "k", "n", "rise"), zip(*out))) if out else {x: [] for x in ("a", "k", "n", "rise")}

    parts = tiled(shadow, ["z", "psr"], tile, halo, solve, "a int, k int, n int, rise double")
    return parts.groupBy("a", "k").agg(F.sum("n").alias("n"), F.sum("rise").alias("rise"))
