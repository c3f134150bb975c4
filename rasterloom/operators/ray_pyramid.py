"""Long rays over large grids without a halo: tiles, a pyramid of block maxima, and segments of rays.

A ray's result splits by tiles. What a tile says about a ray that crosses it is its highest tangent there, the highest
tangent of a target that no nearer pixel of the tile hides, and whether the ray ends there (at a pixel that is missing).
A target is seen if its tangent reaches all that lies before it, so that the parts of a ray are computed apart, in any
tiles at once, and put together by one window over the ray.

1. Every tile casts the rays of its observers over its own pixels. What leaves it unsettled walks on over the pyramid:
   the greatest and least height, the number of pixels and of targets of blocks of BLOCK x BLOCK pixels, of which a tile
   gets those within reach (1 row for BLOCK ** 2 pixels). Front to back, in chunks of BLOCK steps, a chunk is passed over
   where even the highest point of the blocks around it, seen from the observer, does not clear the running horizon; the
   lowest points raise the horizon on the way. Four chunks at once are tried first. Nothing behind the last target counts.
2. The chunks that are left are sent to the tiles that they touch, as rows of a few numbers. Tiles that get many are dealt
   to several tasks.

A pixel is shuffled twice, whatever the reach. A task holds one tile, and the blocks within reach of it. Bounds only decide
which chunks are cast, with SLACK for rounding; tangents are those of casting pixel by pixel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.config import SETTINGS
from rasterloom.operators.ray_tiles import Table, inside, reach, sun_table
from rasterloom.sources.shared import written

BLOCK = 32
COARSE = 4
SLACK = 1e-8
#: Chunks that one task casts in a tile.
CHUNKS = 1_000_000
LOW = -1e18

_SENT = "tr int, tc int, r int, c int, a int, s int, z double, h double, n int"
_SAID = "r int, c int, a int, k int, h double, most double, seen double, ended boolean"


@dataclass(frozen=True)
class Sight:
    """How heights become tangents: over a sphere, or (radius None) a plane; and, for a sun, the tangent that hides it,
    which stands in for the horizon."""

    radius: float | None = None
    sun: float | None = None

    def tangent(self, z0, z, d):
        if self.radius is None:
            return (z - z0) / d
        r1, r2 = self.radius + z0, self.radius + z
        return r1 * (r2 - np.sqrt(d * d + r1 * r1)) / (d * r2)

    def most(self, z0, top, near, far):
        """No pixel up to height top, from near to far, has a greater tangent."""
        if self.radius is None:
            rise, scale = top - z0, 1.0
        else:
            r1, r2 = self.radius + z0, self.radius + np.where(np.isfinite(top), top, 0.0)
            rise, scale = r2 - np.sqrt(near * near + r1 * r1), r1 / r2
        bound = np.where(rise >= 0, rise / near, rise / far) * scale + SLACK
        return np.where(np.isposinf(top), np.inf, bound)

    def least(self, z0, bottom, d):
        """A pixel of height bottom or more, at d, has at least this tangent."""
        known = np.isfinite(bottom)
        return np.where(known, self.tangent(z0, np.where(known, bottom, 0.0), d) - SLACK, LOW)


@dataclass(frozen=True)
class Cast:
    """What is cast over what: rays, the grid's rows and columns (from 0), and the sides of tiles and blocks."""

    table: Table
    sight: Sight
    shape: tuple[int, int]
    tile: int
    block: int

    def __post_init__(self) -> None:
        if self.tile < self.block:
            raise ValueError("a chunk of a ray must not cross a tile's row or column of tiles: blocks are no larger than tiles")


class Pyramid:
    """The blocks within reach of a tile, from block (top, left) on: their extremes with those of the blocks around them."""

    def __init__(self, rows: pa.Table, top: int, left: int, shape: tuple[int, int], grid: tuple[int, int], size: int) -> None:
        self.size, self.top, self.left = size, top, left
        high, low = np.full(shape, -np.inf), np.full(shape, np.inf)
        n, targets = np.zeros(shape, np.int64), np.zeros(shape, bool)
        at = rows.column("br").to_numpy() - top, rows.column("bc").to_numpy() - left
        here = (at[0] >= 0) & (at[0] < shape[0]) & (at[1] >= 0) & (at[1] < shape[1])
        at = at[0][here], at[1][here]
        high[at], low[at], n[at], targets[at] = (rows.column(x).to_numpy(zero_copy_only=False)[here] for x in ("high", "low", "n", "targets"))
        # blocks with pixels missing inside of the grid are never passed over, and raise no horizon
        edge = [np.clip(total - (first + np.arange(k)) * size, 0, size) * (first + np.arange(k) >= 0) for total, first, k in zip(grid, (top, left), shape)]
        open_ = n < edge[0][:, None] * edge[1]
        high[open_], low[open_], targets[open_] = np.inf, -np.inf, True
        self.levels = [self._around(high, low, targets)]
        down, across = (-(-k // COARSE) for k in shape)
        pad = lambda x, v: np.pad(x, ((0, down * COARSE - shape[0]), (0, across * COARSE - shape[1])), constant_values=v).reshape(down, COARSE, across, COARSE)
        self.levels.append(self._around(pad(high, -np.inf).max((1, 3)), pad(low, np.inf).min((1, 3)), pad(targets, False).any((1, 3))))

    @staticmethod
    def _around(high, low, targets):
        """The extremes of 3 x 3 blocks about each; a chunk of a block's length lies within those about its middle."""
        near = lambda x, v, f: f.reduce([np.pad(x, 1, constant_values=v)[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)])
        return near(high, -np.inf, np.maximum), near(low, np.inf, np.minimum), near(targets, False, np.logical_or)

    def look(self, level: int, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest and least height and whether there are targets about pixels."""
        step = self.size * (COARSE if level else 1)
        i, j = (r - self.top * self.size) // step, (c - self.left * self.size) // step
        return tuple(x[i, j] for x in self.levels[level])


def _counts(first: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """How many of a ray's steps (offsets in one axis, monotone) keep positions inside 0 .. n - 1."""
    if not len(offsets) or offsets[-1] == 0:
        return np.full(len(first), len(offsets))
    away = np.abs(offsets)
    return np.searchsorted(away, (n - 1 - first) if offsets[-1] > 0 else first, "right")


def _ahead(cast: Cast, a: int, pyramid: Pyramid, r, c, z, h, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rays along azimuth a from pixels (r, c) that have a horizon h before step k: ray and chunk of what must be cast,
    and the rays that surely meet a pixel that hides the sun."""
    (dr, dc, dist), sight, size = cast.table[a], cast.sight, cast.block
    end = np.minimum(_counts(r, dr, cast.shape[0]), _counts(c, dc, cast.shape[1]))
    h, live, solid, sure = h.copy(), k < end, np.ones(len(r), bool), np.zeros(len(r), bool)
    rays, chunks, with_targets = [], [], []

    def tried(level: int, s: int, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the rays that may meet something in steps s * length to (s + 1) * length."""
        first, last = s * length, min((s + 1) * length, len(dist))
        middle = np.minimum((first + last) // 2, end[at] - 1)  # no step on the grid is farther off than half a chunk
        high, low, targets = pyramid.look(level, r[at] + dr[middle], c[at] + dc[middle])
        may = sight.most(z[at], high, dist[first], dist[last - 1]) >= h[at]
        # the first pixel of what is left of the ray is no lower than the lowest about it
        raised = sight.least(z[at], low, dist[np.minimum(np.maximum(first, k[at]), end[at] - 1)])
        if sight.sun is None:
            done = ~may if level else np.ones(len(at), bool)
            h[at[done]] = np.maximum(h[at[done]], raised[done])
        else:
            hides = solid[at] & (raised >= sight.sun)
            sure[at[hides]], live[at[hides]] = True, False
            may &= ~hides
        if level == 0:
            went = at[may]
            rays.append(went)
            chunks.append(np.full(len(went), s))
            with_targets.append(targets[may])
            solid[went[np.isposinf(high[may])]] = False  # pixels may be missing, which ends a ray
        return at[may]

    long = size * COARSE
    for s in range(int(k[live].min(initial=len(dist))) // long, -(-len(dist) // long)):
        open_ = live & (end > s * long)
        if not open_.any():
            break
        at = np.flatnonzero(open_ & (k < (s + 1) * long))
        left = tried(1, s, at, long) if len(at) else at
        for t in range(s * COARSE, (s + 1) * COARSE):
            some = left[live[left] & (end[left] > t * size) & (k[left] < (t + 1) * size)]
            if len(some):
                tried(0, t, some, size)
    if not rays:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.flatnonzero(sure)
    rays, chunks, with_targets = map(np.concatenate, (rays, chunks, with_targets))
    last = np.full(len(r), -1)
    np.maximum.at(last, rays[with_targets], chunks[with_targets])
    keep = (chunks <= last[rays]) & ~sure[rays]  # nothing is seen behind the last target
    return rays[keep], chunks[keep], np.flatnonzero(sure)


def _own(ray, sight: Sight, z, goal, there, r, c, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rays over their own tile: whether each meets what it looks for, and of those that leave it: number, horizon, step."""
    n, m = z.shape
    at, z0, h = np.arange(len(r)), z[r, c], start.copy()
    seen = np.zeros(len(r), bool)
    out, steps = [], []
    for k, (i, j, d) in enumerate(zip(*ray)):
        y, x = r[at] + i, c[at] + j
        on = (y >= 0) & (y < n) & (x >= 0) & (x < m)
        if not on.all():
            out.append(at[~on])
            steps.append(np.full(len(at) - on.sum(), k))
            at, y, x = at[on], y[on], x[on]
        on = there[y, x]  # a missing pixel ends a ray
        if not on.all():
            at, y, x = at[on], y[on], x[on]
        if not len(at):
            break
        tan = sight.tangent(z0[at], z[y, x], d)
        met = goal[y, x] & (tan >= h[at])
        if sight.sun is None:
            h[at] = np.fmax(h[at], tan)
        if met.any():
            seen[at[met]] = True
            at = at[~met]
    left = np.concatenate([np.zeros(0, np.int64), *out])
    return seen, left, h[left], np.concatenate([np.zeros(0, np.int64), *steps])


def _arrays(group: pa.Table, top: int, left: int, tile: int, columns: list[str]):
    """Places in a tile, where it has pixels, and columns as arrays over it (NaN without a value)."""
    r, c = group.column("r").to_numpy() - top, group.column("c").to_numpy() - left
    there = np.zeros((tile, tile), bool)
    there[r, c] = True
    out = []
    for name in columns:
        x = np.full((tile, tile), np.nan)
        x[r, c] = group.column(name).to_numpy(zero_copy_only=False)
        out.append(x)
    return r, c, there, out


def _blocks(pixels: DataFrame, cast: Cast) -> DataFrame:
    """The blocks within reach of each tile: tr, tc, and a block's place and extremes. A height that is no number counts as
    a missing pixel."""
    size, margin = cast.block, 2 * cast.block
    at = [F.floor(F.col(x) / size).cast("int").alias(f"b{x}") for x in "rc"]
    known = F.col("z").isNotNull() & ~F.isnan("z")
    blocks = pixels.groupBy(*at).agg(F.max("z").alias("high"), F.min("z").alias("low"), F.count_if(known).alias("n"), (F.max("goal") > 0).alias("targets")).filter("n > 0")
    tiles = lambda x, n: F.explode(F.sequence(*[F.floor(e / cast.tile).cast("int") for e in (F.col(x) * size - n - margin, F.col(x) * size + size - 1 + n + margin)]))
    hr, hc = reach(cast.table)
    return blocks.select("*", tiles("br", hr).alias("tr")).select("*", tiles("bc", hc).alias("tc"))


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in schema.split(", "))]


def _first(pixels: DataFrame, cast: Cast, each: bool) -> DataFrame:
    """What is left of every tile's rays: a row of its own (tr null) for each observer that is not settled, or for each
    observer with the number of its rays that met something (each), and a row for each chunk that is to be cast."""
    table, sight, tile, size = cast.table, cast.sight, cast.tile, cast.block
    hr, hc = reach(table)
    kinds = _kinds(_SENT)

    def run(key: tuple, own: pa.Table, blocks: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({x: pa.array([], t) for x, t in kinds})
        top, left = key[0].as_py() * tile, key[1].as_py() * tile
        r, c, there, (z, goal, looks) = _arrays(own, top, left, tile, ["z", "goal", "looks"])
        goal, from_ = goal == 1, looks[r, c] == 1
        r, c = r[from_], c[from_]
        edge = [(t - n) // size - 1 for t, n in ((top, hr), (left, hc))]
        extent = tuple((t + tile + n) // size + 2 - e for t, n, e in ((top, hr, edge[0]), (left, hc, edge[1])))
        pyramid = Pyramid(blocks, *edge, extent, cast.shape, size)
        met = np.zeros(len(r), np.int64)
        start = LOW if sight.sun is None else sight.sun
        parts: list[list[np.ndarray]] = []

        def onward(a: int, obs: np.ndarray, leave: np.ndarray, h: np.ndarray, k: np.ndarray) -> None:
            at = obs[leave]
            z0 = z[r[at], c[at]]
            rays, s, sure = _ahead(cast, a, pyramid, r[at] + top, c[at] + left, z0, h, k)
            met[at[sure]] += 1
            dr, dc, _ = table[a]
            y, x = r[at[rays]] + top, c[at[rays]] + left
            ends = s * size, np.minimum((s + 1) * size, len(dr)) - 1
            rows, columns = ([(p + d[e]) // tile for e in ends] for p, d in ((y, dr), (x, dc)))
            for i in (0, 1):  # a chunk touches no more than the tiles of its ends, and those at their corners
                for j in (0, 1):
                    tr, tc = rows[i], columns[j]
                    go = ((i == 0) | (rows[0] != rows[1])) & ((j == 0) | (columns[0] != columns[1]))
                    go &= (tr != top // tile) | (tc != left // tile)  # done
                    go &= (tr >= 0) & (tc >= 0) & (tr * tile < cast.shape[0]) & (tc * tile < cast.shape[1])
                    parts.append([tr[go], tc[go], y[go], x[go], np.full(int(go.sum()), a), s[go], z0[rays[go]], h[rays[go]]])

        for a, ray in enumerate(table):
            obs = np.arange(len(r)) if each else np.flatnonzero(met == 0)
            seen, *leaving = _own(ray, sight, z, goal, there, r[obs], c[obs], np.full(len(obs), start))
            met[obs[seen]] += 1
            if each:
                onward(a, obs, *leaving)
        obs = np.arange(len(r)) if each else np.flatnonzero(met == 0)
        if not each:  # only observers that saw nothing in any direction look farther
            for a, ray in enumerate(table):
                onward(a, obs, *_own(ray, sight, z, goal, there, r[obs], c[obs], np.full(len(obs), start))[1:])
        sent = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 8
        none, n = np.zeros(len(obs)), len(sent[0])
        told = [none, none, r[obs] + top, c[obs] + left, none, none, none, none, met[obs]]
        mask = np.arange(len(obs) + n) < len(obs)
        arrays = [
            pa.array(np.concatenate([mine, theirs]).astype(t.to_pandas_dtype()), t, mask=mask if x not in ("r", "c", "n") else None)
            for mine, theirs, (x, t) in zip(told, [*sent, np.zeros(n)], kinds)
        ]
        return pa.table(dict(zip((x for x, _ in kinds), arrays)))

    return pixels.groupBy("tr", "tc").cogroup(_blocks(pixels, cast).groupBy("tr", "tc")).applyInArrow(run, _SENT)


def _cast(pixels: DataFrame, sent: DataFrame, cast: Cast) -> DataFrame:
    """What the tiles say about the chunks that were sent to them."""
    parts = sent.groupBy("tr", "tc").agg(F.ceil(F.count(F.lit(1)) / CHUNKS).cast("int").alias("parts"))
    asked = pixels.select("r", "c", "z", "goal", "tr", "tc").join(parts, ["tr", "tc"])
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    dealt = sent.join(parts, ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64("r", "c", "a"), F.col("parts")).cast("int")).drop("parts", "n")
    table, sight, tile, size = cast.table, cast.sight, cast.tile, cast.block
    kinds = _kinds(_SAID)

    def run(key: tuple, rays: pa.Table, own: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * tile, key[1].as_py() * tile
        _, _, there, (z, goal) = _arrays(own, top, left, tile, ["z", "goal"])
        goal, out = goal == 1, []
        azimuth = rays.column("a").to_numpy()
        order = np.argsort(azimuth, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(azimuth[order])) + 1) if len(order) else ():
            a = int(azimuth[part[0]])
            dr, dc, dist = table[a]
            r, c, s, z0, h = (rays.column(x).to_numpy()[part] for x in ("r", "c", "s", "z", "h"))
            most, seen = np.full(len(part), LOW), np.full(len(part), -np.inf)
            first, ended = np.full(len(part), -1), np.zeros(len(part), bool)
            for j in range(size):
                k = s * size + j
                at = np.flatnonzero((k < len(dr)) & ~ended)
                y, x = r[at] + dr[k[at]] - top, c[at] + dc[k[at]] - left
                on = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
                at, y, x = at[on], y[on], x[on]
                new = at[first[at] < 0]
                first[new] = k[new]
                gone = ~there[y, x]
                ended[at[gone]] = True
                at, y, x = at[~gone], y[~gone], x[~gone]
                tan = sight.tangent(z0[at], z[y, x], dist[k[at]])
                record = goal[y, x] & (tan >= (most[at] if sight.sun is None else sight.sun))
                seen[at[record]] = np.maximum(seen[at[record]], tan[record])
                most[at] = np.fmax(most[at], tan)
            hit = first >= 0
            out.append([r[hit], c[hit], np.full(hit.sum(), a), first[hit], h[hit], most[hit], seen[hit], ended[hit]])
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[]] * len(kinds)
        return pa.table({n: pa.array(x, t) for x, (n, t) in zip(columns, kinds)})

    return dealt.groupBy("tr", "tc", "part").cogroup(asked.groupBy("tr", "tc", "part")).applyInArrow(run, _SAID)


def _met(pixels: DataFrame, sent: DataFrame, cast: Cast) -> DataFrame:
    """r, c, a of rays that meet what they look for in the chunks that were sent."""
    before = Window.partitionBy("r", "c", "a").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    stood = F.greatest("h", F.coalesce(F.max("most").over(before), F.lit(LOW))) if cast.sight.sun is None else F.col("h")
    told = _cast(pixels, sent, cast).withColumns({"stood": stood, "over": F.coalesce(F.max("ended").over(before), F.lit(False))})
    return told.filter(~F.col("over") & (F.col("seen") >= F.col("stood"))).select("r", "c", "a").distinct()


def _pixels(grid: DataFrame, tile: int, goal: Column, looks: Column) -> DataFrame:
    place = [F.floor(F.col(x) / tile).cast("int").alias(f"t{x}") for x in "rc"]
    return grid.select("r", "c", F.col("z").cast("double").alias("z"), goal.cast("double").alias("goal"), looks.cast("double").alias("looks"), *place)


def _shape(grid: DataFrame, shape: tuple[int, int] | None) -> tuple[int, int]:
    if shape is not None:
        return shape
    h, w = grid.agg(F.max("r") + 1, F.max("c") + 1).first()
    return h or 0, w or 0


def doubly_shadowed(
    shadow: DataFrame, table: Table, tile: int = 512, radius: float | None = SETTINGS.moon_radius_m, target: str | None = None,
    shape: tuple[int, int] | None = None, block: int = BLOCK,
) -> DataFrame:
    """r, c of shadowed pixels that see no pixel out of the shadow (none whose column `target` is 1, if given), over a
    sphere, or over a plane without radius. A missing pixel ends a ray; rows and columns count from 0."""
    shape = _shape(shadow, shape)
    goal = F.col("psr") == 0 if target is None else F.col(target) == 1
    pixels = _pixels(shadow, tile, F.coalesce(goal, F.lit(False)), F.coalesce(F.col("psr") == 1, F.lit(False)))
    cast = Cast(inside(table, *shape), Sight(radius), shape, tile, block)
    first = written(_first(pixels, cast, False), "rays")
    seen = _met(pixels, first.filter("tr is not null"), cast).select("r", "c").distinct()
    return first.filter("tr is null").select("r", "c").join(seen, ["r", "c"], "left_anti")


def illumination(
    dem: DataFrame, azimuths: list[float], elevation: float, max_steps: int, tile: int = 512, cell: float = SETTINGS.cell_m,
    shape: tuple[int, int] | None = None, block: int = BLOCK,
) -> DataFrame:
    """r, c, lit and n_dark (azimuths whose sun is hidden) of every pixel."""
    shape = _shape(dem, shape)
    cast = Cast(inside(sun_table(azimuths, max_steps, cell), *shape), Sight(None, math.tan(math.radians(elevation))), shape, tile, block)
    pixels = _pixels(dem, tile, F.lit(True), F.lit(True))
    first = written(_first(pixels, cast, True), "suns")
    far = _met(pixels, first.filter("tr is not null"), cast).groupBy("r", "c").agg(F.count(F.lit(1)).cast("int").alias("far"))
    own = first.filter("tr is null").select("r", "c", F.col("n").alias("near"))
    dark = (F.col("near") + F.coalesce("far", F.lit(0))).alias("n_dark")
    return own.join(far, ["r", "c"], "left").select("r", "c", dark).select("r", "c", (F.col("n_dark") < len(azimuths)).cast("int").alias("lit"), "n_dark")
