"""Least-cost paths over a cost surface: a graph of region borders, searched from the start, and refined in the regions crossed.

A step from a pixel to one of its eight neighbours costs its length times the mean of both pixels' costs. Pixels without a
cost, or with one that is not over 0, cannot be entered."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.shared import discard, written

#: Pixels along a tile, border pixels of a region at most, and regions joined at once.
TILE, MOST, JOINED = 64, 1024, 8
_MOVES = [(a, b, math.hypot(a, b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_EDGES = "r int, c int, r2 int, c2 int, w double"
#: A region: its place among those of its level, its border pixels with their costs, and what it costs between each two without leaving it.
_REGIONS = "tr int, tc int, r array<int>, c array<int>, z array<double>, d binary"
_LEGS = "key array<int>, r int, c int, dist double, r2 int, c2 int"
#: All sides of a tile lead on.
_ENDLESS = (-math.inf, math.inf, -math.inf, math.inf)


def _spread(cost: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed (its index in the flat tile) the least cost to every pixel inside of the tile, relaxed over whole arrays
    until nothing improves. cost: NaN without a pixel."""
    h, w = cost.shape
    padded = np.pad(cost, 1, constant_values=np.nan)
    steps = [(a, b, np.nan_to_num(s / 2 * (cost + padded[1 + a : 1 + a + h, 1 + b : 1 + b + w]), nan=np.inf)) for a, b, s in _MOVES]
    d = np.full((len(seeds), h + 2, w + 2), np.inf)
    inner = d[:, 1:-1, 1:-1]
    inner.reshape(len(seeds), h, w)[np.arange(len(seeds)), seeds // w, seeds % w] = 0.0
    while True:
        best = inner.copy()
        for a, b, step in steps:
            np.minimum(best, d[:, 1 + a : 1 + a + h, 1 + b : 1 + b + w] + step, out=best)
        if not (best < inner - 1e-12).any():
            return inner
        inner[:] = best


def _steps(ya: np.ndarray, xa: np.ndarray, yb: np.ndarray, xb: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """By move the pairs of pixels, of a and of b, that it leads between, and its length."""
    at, out = {p: k for k, p in enumerate(zip(yb.tolist(), xb.tolist()))}, []
    for dy, dx, s in _MOVES:
        found = [(k, at[y + dy, x + dx]) for k, (y, x) in enumerate(zip(ya.tolist(), xa.tolist())) if (y + dy, x + dx) in at]
        if found:
            out.append((*np.array(found).T, s))
    return out


def _met(a: np.ndarray, b: np.ndarray, steps: list) -> np.ndarray:
    """Least costs between all pixels of two parts (n, pixels, pixels), from those inside of each and steps (i of a, j of b, their costs).
    What passes from one to the other leaves a by some i, so that these alone need be tried as stops on the way."""
    n = a.shape[1]
    d = np.full((len(a), n + b.shape[1], n + b.shape[1]), np.inf)
    d[:, :n, :n], d[:, n:, n:] = a, b
    for i, j, w in steps:
        d[:, n:, i] = np.minimum(d[:, n:, i], b[:, :, j] + w[:, None, :])
    side = np.unique(np.concatenate([i for i, _, _ in steps])) if steps else np.empty(0, int)
    for i, j, w in steps:
        to = (slice(None), i[:, None], side[None, :])
        d[to] = np.minimum(d[to], w[:, :, None] + d[:, n + j[:, None], side[None, :]])
    d[:, :n, n:] = d[:, n:, :n].transpose(0, 2, 1)
    for k in side:
        np.minimum(d, d[:, :, k, None] + d[:, None, k, :], out=d)
    return d


@functools.cache
def _border(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices((h, w)).reshape(2, -1)
    on = (y == 0) | (y == h - 1) | (x == 0) | (x == w - 1)
    return y[on], x[on]


@functools.cache
def _halves(h: int, w: int) -> tuple:
    """The axis and the place where an array is cut, the steps over the cut, and which border pixels of the halves are on its own."""
    axis = int(w > h)
    cut = (h, w)[axis] // 2
    (ya, xa), (yb, xb) = _border(*((cut, w) if axis == 0 else (h, cut))), _border(*((h - cut, w) if axis == 0 else (h, w - cut)))
    yb, xb = (yb + cut, xb) if axis == 0 else (yb, xb + cut)
    at = {p: k for k, p in enumerate(zip(np.concatenate([ya, yb]).tolist(), np.concatenate([xa, xb]).tolist()))}
    keep = np.array([at[p] for p in zip(*(k.tolist() for k in _border(h, w)))])
    return axis, cut, (ya, xa), (yb, xb), _steps(ya, xa, yb, xb), keep


def _closure(z: np.ndarray) -> np.ndarray:
    """For arrays of costs (n, h, w; infinite without a pixel) the least costs between their border pixels, inside of each array: by halves,
    whose border pixels meet over the cut. Halves of one shape are taken at once."""
    n, h, w = z.shape
    if h * w == 1:
        return np.zeros((n, 1, 1))
    axis, cut, a, b, steps, keep = _halves(h, w)
    za, zb = (z[:, :cut], z[:, cut:]) if axis == 0 else (z[:, :, :cut], z[:, :, cut:])
    both = _closure(np.concatenate([za, zb])) if za.shape == zb.shape else None
    da, db = (both[:n], both[n:]) if both is not None else (_closure(za), _closure(zb))
    ca, cb = z[:, *a], z[:, *b]
    d = _met(da, db, [(i, j, s / 2 * (ca[:, i] + cb[:, j])) for i, j, s in steps])
    return d[:, keep[:, None], keep[None, :]]


def _array(group: pa.Table) -> tuple[np.ndarray, int, int]:
    r, c = group.column("r").to_numpy(), group.column("c").to_numpy()
    top, left = int(r.min()), int(c.min())
    cost = np.full((int(r.max()) - top + 1, int(c.max()) - left + 1), np.nan)
    cost[r - top, c - left] = group.column("cost").to_numpy()
    return cost, top, left


def _pixels(cost: DataFrame, tile: int) -> DataFrame:
    place = [F.floor(F.col(x) / tile).cast("int").alias(f"t{x}") for x in "rc"]
    known = cost.filter("cost > 0 and not isnan(cost)")
    return known.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("cost").cast("double").alias("cost"), *place)


def _leads_on(r: np.ndarray, c: np.ndarray, box: tuple, ends: tuple, places: list[tuple[int, int]]) -> np.ndarray:
    """Pixels on a side of a region (first and last row and column in box) beyond which the grid (the same, in ends) goes on; and the places."""
    on = ((r == box[0]) & (r > ends[0])) | ((r == box[1]) & (r < ends[1])) | ((c == box[2]) & (c > ends[2])) | ((c == box[3]) & (c < ends[3]))
    for a, b in places:
        on |= (r == a) & (c == b)
    return on


def _tiles(cost: DataFrame, places: list[tuple[int, int]], tile: int, ends: tuple = _ENDLESS) -> DataFrame:
    """Tiles as regions. Border pixels are those from which a neighbour in another tile may be entered, and the places."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        z, top, left = _array(group)
        tr, tc = (k.as_py() for k in key)
        y, x = _border(*z.shape)
        box = (tr * tile, tr * tile + tile - 1, tc * tile, tc * tile + tile - 1)
        on = _leads_on(y + top, x + left, box, ends, places) & ~np.isnan(z[y, x])
        d = _closure(np.where(np.isnan(z), np.inf, z)[None])[0][on][:, on] if on.any() else np.empty((0, 0))
        y, x = y[on], x[on]
        for a, b in {(a - top, b - left) for a, b in places}:
            inside = 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and not np.isnan(z[a, b])
            if inside and not ((y == a) & (x == b)).any():
                (far,) = _spread(z, np.array([a * z.shape[1] + b]))
                d = np.block([[d, far[y, x][:, None]], [far[y, x][None, :], np.zeros((1, 1))]])
                y, x = np.append(y, a), np.append(x, b)
        return _region(tr, tc, y + top, x + left, z[y, x], d)

    return _pixels(cost, tile).groupBy("tr", "tc").applyInArrow(run, _REGIONS)


def _region(tr: int, tc: int, r: np.ndarray, c: np.ndarray, z: np.ndarray, d: np.ndarray) -> pa.Table:
    lists = {"r": pa.array([r.astype(np.int32)], pa.list_(pa.int32())), "c": pa.array([c.astype(np.int32)], pa.list_(pa.int32())), "z": pa.array([z], pa.list_(pa.float64()))}
    return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), **lists, "d": pa.array([np.ascontiguousarray(d).tobytes()], pa.binary())})


def _parts(group: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    for k in range(group.num_rows):
        r, c, z = (np.array(group.column(n)[k].as_py(), t) for n, t in (("r", np.int64), ("c", np.int64), ("z", np.float64)))
        yield group.column("tr")[k].as_py(), group.column("tc")[k].as_py(), r, c, z, np.frombuffer(group.column("d")[k].as_py()).reshape(len(r), len(r))


def _above(f: tuple[int, int], r: str = "tr", c: str = "tc") -> list[Column]:
    return [F.floor(F.col(k) / n).cast("int").alias(m) for k, n, m in zip((r, c), f, ("ur", "uc"))]


def _join(regions: DataFrame, f: tuple[int, int], size: tuple[int, int], ends: tuple, places: list[tuple[int, int]]) -> DataFrame:
    """Regions of f[0] x f[1] regions, which are of this size, joined two by two; only border pixels of what is joined stay."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ur, uc = (k.as_py() for k in key)
        own = {x[:2]: x[2:] for x in _parts(group)}

        def build(t: int, u: int, v: int, w: int) -> tuple | None:
            if (u - t) * (w - v) == 1:
                return own.get((t, v))
            m = (t + u) // 2 if u - t >= w - v else (v + w) // 2
            a, b = (build(t, m, v, w), build(m, u, v, w)) if u - t >= w - v else (build(t, u, v, m), build(t, u, m, w))
            if a is None or b is None:
                return a or b
            steps = [(i, j, (s / 2 * (a[2][i] + b[2][j]))[None]) for i, j, s in _steps(a[0], a[1], b[0], b[1])]
            d = _met(a[3][None], b[3][None], steps)[0]
            r, c, z = (np.concatenate([a[k], b[k]]) for k in range(3))
            on = _leads_on(r, c, (t * size[0], u * size[0] - 1, v * size[1], w * size[1] - 1), ends, places)
            return r[on], c[on], z[on], d[on][:, on]

        return _region(ur, uc, *build(ur * f[0], ur * f[0] + f[0], uc * f[1], uc * f[1] + f[1]))

    up = regions.select(*_above(f), "*")
    return up.groupBy("ur", "uc").applyInArrow(run, _REGIONS)


def _graph(regions: DataFrame) -> DataFrame:
    """r, c, r2, c2, w: between border pixels of a region, and between neighbours in different ones. Both ways of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, r, c, _, d in _parts(batch):
                i, j = np.nonzero(np.isfinite(d) & (d > 0))
                columns = [pa.array(x, pa.int32()) for x in (r[i], c[i], r[j], c[j])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(d[i, j])], names=["r", "c", "r2", "c2", "w"])

    inside = regions.mapInArrow(run, _EDGES)
    border = regions.select("tr", "tc", F.explode(F.arrays_zip("r", "c", "z")).alias("p")).select("tr", "tc", "p.r", "p.c", "p.z")
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s")) for a, b, s in _MOVES])).alias("m")
    out = border.select("*", moves).withColumns({"r2": F.col("r") + F.col("m.a"), "c2": F.col("c") + F.col("m.b")})
    there = border.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2"), F.col("tr").alias("tr2"), F.col("tc").alias("tc2"))
    out = out.join(there, ["r2", "c2"]).filter("tr <> tr2 or tc <> tc2")
    return inside.union(out.select("r", "c", "r2", "c2", F.col("m.s") / 2 * (F.col("z") + F.col("z2"))))


def border_graph(cost: DataFrame, places: list[tuple[int, int]], tile: int = TILE) -> DataFrame:
    """r, c, r2, c2, w: what it costs between any two border pixels of a tile (and the places inside of it), without leaving
    it, and between neighbours in different tiles. Both ways of a pair; about 8 rows for each pixel at the usual tile."""
    return _graph(written(_tiles(cost, places, tile), "regions"))


def _unfolded(legs: DataFrame, regions: DataFrame, f: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """Legs inside of joined regions as legs of the regions (of this size) that were joined, f[0] x f[1] of them."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            parts = list(_parts(own))
            r, c, z = (np.concatenate([x[k] for x in parts]) for k in (2, 3, 4))
            of = np.repeat(np.arange(len(parts)), [len(x[2]) for x in parts])
            d = np.full((len(r), len(r)), np.inf)
            for k, x in enumerate(parts):
                d[np.ix_(of == k, of == k)] = x[5]
            for i, j, s in _steps(r, c, r, c):
                i, j = i[of[i] != of[j]], j[of[i] != of[j]]
                d[i, j] = s / 2 * (z[i] + z[j])
            at = {p: k for k, p in enumerate(zip(r.tolist(), c.tolist()))}
            for key, r1, c1, dist, r2, c2 in zip(*(asked.column(x).to_pylist() for x in ("key", "r", "c", "dist", "r2", "c2"))):
                start, goal = at[r1, c1], at[r2, c2]
                far, last, open_ = np.full(len(r), np.inf), np.full(len(r), -1), np.zeros(len(r))
                far[start] = 0.0
                while (k := int(np.argmin(far + open_))) != goal:  # the nearest pixel that is not settled
                    open_[k] = np.inf
                    better = far[k] + d[k] < far
                    far[better], last[better] = far[k] + d[k][better], k
                way = [goal]
                while way[-1] != start:
                    way.append(int(last[way[-1]]))
                way.reverse()
                out += [([*key, n], int(r[a]), int(c[a]), dist + float(far[a]), int(r[b]), int(c[b])) for n, (a, b) in enumerate(zip(way, way[1:]))]
        types = (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(zip(("key", "r", "c", "dist", "r2", "c2"), types))})

    inside = legs.select(*_above((f[0] * size[0], f[1] * size[1]), "r", "c"), "*")
    return regions.select(*_above(f), "*").groupBy("ur", "uc").cogroup(inside.groupBy("ur", "uc")).applyInArrow(run, _LEGS)


def _numbered(path: DataFrame) -> DataFrame:
    """r, c, k and dist of rows in the order of their keys: dealt out by range, numbered in each part, and the parts counted."""
    low = 33  # bits of a row's number inside of its part
    path = written(path.repartitionByRange("key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()), "path")
    counts = sorted((x["part"], x["n"]) for x in path.groupBy(F.shiftright("id", low).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in counts]).tolist()
    parts = path.sparkSession.createDataFrame([(part, n) for (part, _), n in zip(counts, before)], "part long, before long")
    k = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << low) - 1))
    return path.withColumn("part", F.shiftright("id", low)).join(F.broadcast(parts), "part").select("r", "c", k.cast("int").alias("k"), "dist")


def _inside(size: tuple[int, int]) -> Column:
    """Legs that begin and end in one region of this size."""
    same = [F.floor(F.col(k) / n) == F.floor(F.col(f"{k}2") / n) for k, n in zip("rc", size)]
    return same[0] & same[1]


def least_path(cost: DataFrame, start: tuple[int, int], goal: tuple[int, int], tile: int = TILE, most: int = MOST) -> DataFrame:
    """r, c, k (from 0) and dist (from the start) of the pixels of a least-cost path from start to goal; no row where nothing
    leads there. Of equal paths one is taken, the same in every run.

    Costs between border pixels are found inside tiles once. Tiles are joined to regions, and these to larger ones, as long as
    those have at most `most` border pixels. Then border pixels of regions move: a round goes from those that improved over a region and
    over its edge, so that there are about as many rounds as regions on the path; rounds are written. What cannot beat the
    goal's best cost any more, by the least cost of a pixel times the way that is left, stops. The path is followed back from
    border pixel to border pixel, and its legs are found again, level by level, in the regions they cross, and last in tiles."""
    spark, places = cost.sparkSession, [start, goal]
    none = spark.createDataFrame([], "r int, c int, k int, dist double")
    known = _pixels(cost, tile)
    at_places = F.count_if((F.col("r") == start[0]) & (F.col("c") == start[1])), F.count_if((F.col("r") == goal[0]) & (F.col("c") == goal[1]))
    *ends, cheapest, one, other = known.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.min("cost"), *at_places).first()
    if not one or not other:
        return none
    ends = tuple(ends)

    def regions_along(k: tuple[int, int]) -> tuple[int, int]:
        return tuple(ends[2 * a + 1] // (tile * n) - ends[2 * a] // (tile * n) + 1 for a, n in enumerate(k))

    def border(k: tuple[int, int]) -> int:
        nr, nc = regions_along(k)
        return 2 * min(tile * k[1], ends[3] - ends[2] + 1) * (nr > 1) + 2 * min(tile * k[0], ends[1] - ends[0] + 1) * (nc > 1)

    levels, size, f = [written(_tiles(cost, places, tile, ends), "regions")], [(1, 1)], []
    while True:
        k, by = size[-1], (1, 1)
        while by[0] * by[1] < JOINED:
            now = (k[0] * by[0], k[1] * by[1])
            wider = [x for x, n in zip(((2 * by[0], by[1]), (by[0], 2 * by[1])), regions_along(now)) if n > 1]
            wider = [x for x in wider if border((k[0] * x[0], k[1] * x[1])) <= most]
            if not wider:
                break
            by = min(wider, key=lambda x: border((k[0] * x[0], k[1] * x[1])))
        if by == (1, 1):
            break
        levels.append(written(_join(levels[-1], by, (tile * k[0], tile * k[1]), ends, places), "regions"))
        size.append((k[0] * by[0], k[1] * by[1]))
        f.append(by)
    size = [(tile * a, tile * b) for a, b in size]
    edges = written(_graph(levels[-1]), "edges")
    away = [F.abs(F.col(x) - g) for x, g in zip(("r", "c"), goal)]
    bound = F.lit(float(cheapest)) * (F.greatest(*away) + (math.sqrt(2) - 1) * F.least(*away))
    state = written(spark.createDataFrame([(*start, 0.0, None, None, True)], "r int, c int, dist double, pr int, pc int, new boolean"), "reached")
    best = 0.0 if start == goal else math.inf
    while state.filter("new").head(1):
        front = state.filter("new").select("r", "c", "dist")
        told = front.join(edges, ["r", "c"]).select(F.col("r2").alias("r"), F.col("c2").alias("c"), (F.col("dist") + F.col("w")).alias("dist"), F.col("r").alias("pr"), F.col("c").alias("pc"))
        told = told.filter(F.col("dist") + bound <= best * (1 + 1e-9)) if best < math.inf else told
        both = told.select("r", "c", F.struct("dist", "pr", "pc", F.lit(True).alias("new")).alias("v")).union(state.select("r", "c", F.struct("dist", "pr", "pc", F.lit(False).alias("new"))))
        old = F.min(F.when(~F.col("v.new"), F.col("v.dist"))).alias("old")
        merged = both.groupBy("r", "c").agg(F.min("v").alias("v"), old)
        better = F.col("v.new") & (F.col("old").isNull() | (F.col("v.dist") < F.col("old") - 1e-12))
        last, state = state, written(merged.select("r", "c", "v.dist", "v.pr", "v.pc", better.alias("new")), "reached")
        discard(last)
        at = state.filter((F.col("r") == goal[0]) & (F.col("c") == goal[1])).first()
        best = at["dist"] if at else best
    if best == math.inf:
        return none
    # followed back: as many look-ups as border pixels on the path, a few for each region of the last level that it crosses
    nodes, at = [], goal
    while at is not None:
        row = state.filter((F.col("r") == at[0]) & (F.col("c") == at[1])).first()
        nodes.append((*at, row["dist"]))
        at = None if row["pr"] is None else (row["pr"], row["pc"])
    nodes.reverse()
    legs = spark.createDataFrame([([k], *a, *b[:2]) for k, (a, b) in enumerate(zip(nodes, nodes[1:]))], _LEGS)
    for regions, by, of in reversed(list(zip(levels, f, size))):
        whole = _inside((of[0] * by[0], of[1] * by[1]))
        before, legs = legs, written(_unfolded(legs.filter(whole), regions, by, of).union(legs.filter(~whole)), "legs")
        discard(before)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            z, top, left = _array(own)
            w = z.shape[1]
            for key, r, c, dist, r2, c2 in zip(*(asked.column(x).to_pylist() for x in ("key", "r", "c", "dist", "r2", "c2"))):
                (d,) = _spread(z, np.array([(r - top) * w + c - left]))
                y, x, back = r2 - top, c2 - left, []
                while (y, x) != (r - top, c - left):  # to a neighbour from which the pixel is reached at its cost
                    back.append((y, x, d[y, x]))
                    near = [(abs(d[y + a, x + b] + s / 2 * (z[y, x] + z[y + a, x + b]) - d[y, x]), y + a, x + b) for a, b, s in _MOVES if 0 <= y + a < z.shape[0] and 0 <= x + b < w and d[y + a, x + b] < d[y, x]]
                    _, y, x = min(near)
                back.append((y, x, 0.0))
                out += [([*key, n], y + top, x + left, dist + e) for n, (y, x, e) in enumerate(back[:0:-1])]
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate((("key", pa.list_(pa.int32())), ("r", pa.int32()), ("c", pa.int32()), ("dist", pa.float64())))})

    whole = _inside((tile, tile))
    crossed = legs.filter(whole).select(*[F.floor(F.col(k) / tile).cast("int").alias(f"t{k}") for k in "rc"], "*")
    between = known.groupBy("tr", "tc").cogroup(crossed.groupBy("tr", "tc")).applyInArrow(run, "key array<int>, r int, c int, dist double")
    last = spark.createDataFrame([([len(nodes)], *nodes[-1])], "key array<int>, r int, c int, dist double")
    out = _numbered(between.union(legs.filter(~whole).select("key", "r", "c", "dist")).union(last))
    discard(*levels, edges, state, legs)
    return out
