"""Polygons as tables of sides (poly, x1, y1, x2, y2): any number of them, with holes and several parts.

A polygon's inside is by crossing parity over all of its rings. Coverage goes by scan lines; the nearest side by a grid
index of sides, whose cells send to points outside of them only what can be nearest from there, in equi-joins throughout."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources.shared import discard, written

ENDS = ("x1", "y1", "x2", "y2")
#: Blocks along a tile of points, strips of a cell in which sides cover each other, about the most sides of a group, and distances at once.
TILE, STRIPS, PART, ROOM = 8, 64, 1 << 16, 1 << 13


def sides_of(rings: DataFrame, key: str, points: str) -> DataFrame:
    """A side for each point of each ring (key, an array of structs x, y) to the next one, the last to the first."""
    n = F.size(points)
    at = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, (i + 1) % n).alias("b")))
    out = rings.filter(n > 0).select(F.col(key).alias("poly"), F.explode(at).alias("s"))
    return out.select("poly", *[F.col(f"s.{p}.{k}").cast("double").alias(f"{k}{i}") for i, p in ((1, "a"), (2, "b")) for k in "xy"])


def covered(grid: DataFrame, sides: DataFrame) -> DataFrame:
    """r, c, inside: 1 where a pixel's centre (c + 0.5, r + 0.5) lies in some polygon.

    Sides are cut with the lines of pixels that they straddle. Sorted along a line, a polygon's crossings begin and end its
    spans by turns; a span adds one at its first pixel and takes it back behind its last, and a running sum along the
    line counts the spans over each pixel."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lines = F.sequence(F.floor(low - 0.5).cast("int"), F.floor(high + 0.5).cast("int"))
    cut = sides.select("*", F.explode(lines).alias("r")).withColumn("yc", F.col("r") + 0.5)
    cut = cut.filter((F.col("y1") > F.col("yc")) != (F.col("y2") > F.col("yc")))
    x = F.col("x1") + (F.col("yc") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    turn = F.when(F.row_number().over(Window.partitionBy("r", "poly").orderBy("x")) % 2 == 1, 1).otherwise(-1)
    steps = cut.select("r", "poly", x.alias("x")).select("r", F.ceil(F.col("x") - 0.5).cast("int").alias("c"), turn.alias("step"))
    both = grid.select("r", "c", F.lit(0).alias("step"), F.lit(True).alias("own")).union(steps.groupBy("r", "c").agg(F.sum("step").cast("int"), F.lit(False)))
    over = F.sum("step").over(Window.partitionBy("r").orderBy("c").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("over", over).filter("own").select("r", "c", (F.col("over") > 0).cast("int").alias("inside"))


def _cells(sides: DataFrame, cell: float) -> DataFrame:
    """Sides with the cells (i, j) that they may touch, once each; long sides are walked in pieces no longer than a cell, so that
    they take the cells about them and not their box."""
    long = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    n = F.greatest(F.ceil(long / cell), F.lit(1)).cast("int")
    piece = sides.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    ends = {k: [F.col(f"{k}1") + (F.col(f"{k}2") - F.col(f"{k}1")) * (F.col("k") + e) / F.col("n") for e in (0, 1)] for k in "xy"}
    span = lambda k: F.explode(F.sequence(*[F.floor(f(*ends[k]) / cell + e).cast("long") for f, e in ((F.least, -1e-9), (F.greatest, 1e-9))]))
    return piece.select("*", span("x").alias("i")).select("*", span("y").alias("j")).select(*ENDS, "i", "j").distinct()


def _around(blocks: DataFrame) -> DataFrame:
    """Blocks with each of the nine cells about theirs, on level l, whose cells are 2 ** l wide."""
    wide = F.pow(F.lit(2.0), F.col("l"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")
    at = [(F.floor(F.col(f"b{k}") / wide).cast("long") + F.col(f"d.{a}")).alias(f"l{k}") for k, a in (("i", "a"), ("j", "b"))]
    return blocks.select("*", near).select(*blocks.columns, *at)


def _ways(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, i: np.ndarray, j: np.ndarray, cell: float) -> np.ndarray:
    """From where each side can be the nearest one of its cell (i, j), for points beyond an edge of the cell: bits for greater y,
    smaller y, greater x, smaller x.

    Of two places with one x, that of greater y is nearer to all points of greater y yet. So from there only what no other
    side covers counts. Cells are cut into strips; a side that crosses a strip covers what lies wholly behind it there, and all that
    is not known to be covered stays."""
    d, start = (x2 - x1, y2 - y1), (x1, y1)
    t0, t1 = np.zeros(len(x1)), np.ones(len(x1))
    for a, by, low in zip(start, d, (i * cell, j * cell)):
        high = low + cell
        flat = by == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            ta, tb = (low - a) / by, (high - a) / by
        t0 = np.maximum(t0, np.where(flat, np.where((a >= low) & (a <= high), 0.0, 2.0), np.minimum(ta, tb)))
        t1 = np.minimum(t1, np.where(flat, 1.0, np.maximum(ta, tb)))
    own = np.nonzero(t0 <= t1 + 1e-12)[0]
    ways = np.zeros(len(x1), np.int32)
    if not len(own):
        return ways
    number = np.unique(np.stack([i[own], j[own]], 1), axis=0, return_inverse=True)[1].reshape(-1)
    ends = [[(a + t * by)[own] for t in (t0, t1)] for a, by in zip(start, d)]
    wide = cell / STRIPS
    for along, low, across, bits in ((0, i, 1, (1, 2)), (1, j, 0, (4, 8))):
        u, v = [e - low[own] * cell for e in ends[along]], ends[across]
        ua, ub = np.minimum(*u), np.maximum(*u)
        first, last = (np.clip(np.floor(e / wide), 0, STRIPS - 1).astype(np.int64) for e in (ua, ub))
        n = last - first + 1
        k = np.repeat(np.arange(len(own)), n)
        strip = first[k] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left, right = strip * wide, (strip + 1) * wide
        crosses = (ua[k] <= left) & (ub[k] >= right)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (v[1] - v[0]) / (u[1] - u[0])
        least, most = np.minimum(*v), np.maximum(*v)
        steep = ~np.isfinite(slope)
        there = [np.where(steep[k], e[k], np.clip(v[0][k] + (np.clip(x, ua[k], ub[k]) - u[0][k]) * slope[k], least[k], most[k])) for x, e in ((left, least), (right, most))]
        place = number[k] * STRIPS + strip
        for sign, bit in zip((1, -1), bits):
            near, far = np.maximum(sign * there[0], sign * there[1]), np.minimum(sign * there[0], sign * there[1])
            cover = np.full((number.max() + 1) * STRIPS, -np.inf)
            np.maximum.at(cover, place[crosses], far[crosses])
            ways[own[np.unique(k[near >= cover[place] - 1e-9])]] |= bit
    return ways


def _nearest(own: pa.Table, other: pa.Table, cell: float) -> np.ndarray:
    """For each point of a tile the distance to the nearest of the sides sent to it. Block by block of a cell: of its own cell a block takes all
    sides, of others those seen from it, and of these what is no farther from its middle than the nearest one and its width; quarters
    of it the same again, while points times sides are many."""
    px, py, bi, bj = (own.column(x).to_numpy() for x in ("px", "py", "bi", "bj"))
    x1, y1, x2, y2, i, j, ways = (other.column(x).to_numpy() for x in (*ENDS, "i", "j", "ways"))
    dx, dy = x2 - x1, y2 - y1
    q = dx * dx + dy * dy
    side = np.stack([x1, y1, dx, dy, np.where(q > 0, q, 1.0)])

    def squares(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        x1, y1, dx, dy, q = side[:, k]
        ex, ey = x[:, None] - x1, y[:, None] - y1
        t = ex * dx
        t += ey * dy
        t /= q
        np.minimum(t, 1.0, out=t)
        np.maximum(t, 0.0, out=t)
        ex -= t * dx
        ey -= t * dy
        ex *= ex
        ey *= ey
        ex += ey
        return ex

    out = np.full(len(px), np.inf)
    number = np.unique(np.stack([bi, bj], 1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(number, kind="stable")
    for at in np.split(order, np.nonzero(np.diff(number[order]))[0] + 1):
        a, b = bi[at[0]], bj[at[0]]
        seen = np.where(j < b, 1, np.where(j > b, 2, np.where(i < a, 4, 8)))
        k = np.nonzero((ways & seen != 0) | ((i == a) & (j == b)))[0]
        if not len(k):
            continue
        todo = [(at, k)]
        while todo:
            at, k = todo.pop()
            x, y = px[at], py[at]
            if len(at) * len(k) <= ROOM or len(at) <= 4:
                for n in range(0, len(k), ROOM):
                    out[at] = np.minimum(out[at], squares(x, y, k[n : n + ROOM]).min(1))
                continue
            mx, my = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
            far = np.sqrt(squares(np.array([mx]), np.array([my]), k)[0])
            k = k[far <= far.min() + 2 * np.hypot(x - mx, y - my).max() + 1e-6]
            if len(at) * len(k) <= ROOM or (x.min() == x.max() and y.min() == y.max()):
                todo += [(at[n : n + 4], k) for n in range(0, len(at), 4)] if len(at) * len(k) > ROOM else [(at, k)]
            else:
                quarter = (x > mx) * 2 + (y > my)
                todo += [(at[quarter == n], k) for n in range(4) if (quarter == n).any()]
    return np.sqrt(out)


def met_sides(blocks: DataFrame, sides: DataFrame, cell: float) -> DataFrame | None:
    """ti, tj, part, the ends of a side, its cell i, j and ways: the sides that tiles of TILE x TILE blocks (bi, bj) meet. Sides of a tile's
    own cells come in parts of about PART; those of others only if they can be the nearest ones from it. None without sides or blocks.

    The nearest filled cells about a block, on all levels at once, bound how far its nearest side can be; on the level whose cells
    are as wide as that bound, the nine cells about the block hold all filled cells within it."""
    tile = lambda k: F.floor(F.col(k) / TILE).cast("long")
    index = written(_cells(sides, cell).withColumns({"ti": tile("i"), "tj": tile("j")}), "cells")
    ends = [df.agg(*[f(k) for k in names for f in (F.min, F.max)]).first() for df, names in ((index, "ij"), (blocks, ("bi", "bj")))]
    if any(e[0] is None for e in ends):
        return None
    extent = max(max(e[k + 1] for e in ends) - min(e[k] for e in ends) + 1 for k in (0, 2))
    top = math.ceil(math.log2(extent)) + 1
    parts = index.groupBy("ti", "tj").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = index.join(parts, ["ti", "tj"]).withColumn("part", F.pmod(F.xxhash64(*ENDS), F.col("parts")).cast("int"))

    def seen(group: pa.Table) -> pa.Table:
        x = [group.column(k).to_numpy() for k in (*ENDS, "i", "j")]
        return group.select(["ti", "tj", "part", *ENDS, "i", "j"]).append_column("ways", pa.array(_ways(*x, cell)))

    schema = "ti long, tj long, part int, " + "".join(f"{k} double, " for k in ENDS) + "i long, j long, ways int"
    own = written(dealt.drop("parts").groupBy("ti", "tj", "part").applyInArrow(seen, schema), "seen")
    discard(index)
    levels = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("l")
    wide = F.pow(F.lit(2.0), F.col("l"))
    filled = own.select("i", "j").distinct().select("i", "j", levels)
    filled = written(filled.select("*", *[F.floor(F.col(k) / wide).cast("long").alias(f"l{k}") for k in "ij"]), "filled")
    middle = {k: (F.col(f"b{k}") + 0.5) * cell for k in "ij"}
    looked = _around(blocks.select("*", levels)).join(filled.select("l", "li", "lj").distinct(), ["l", "li", "lj"])
    reach = {k: F.greatest(*[F.abs((F.col(f"l{k}") + a) * cell * wide - middle[k]) for a in (0, 1)]) for k in "ij"}
    half = cell * math.sqrt(2) / 2
    bound = looked.groupBy("bi", "bj").agg((F.min(F.sqrt(reach["i"] * reach["i"] + reach["j"] * reach["j"])) + (2 * half + 1e-6)).alias("most"))
    level = F.least(F.greatest(F.ceil(F.log2(F.col("most") / cell)), F.lit(0)), F.lit(top)).cast("int")
    asked = _around(bound.select("*", level.alias("l"))).join(filled, ["l", "li", "lj"])
    apart = {k: F.greatest(F.col(k) * cell - middle[k], middle[k] - (F.col(k) + 1) * cell, F.lit(0.0)) for k in "ij"}
    asked = asked.filter(F.sqrt(apart["i"] * apart["i"] + apart["j"] * apart["j"]) <= F.col("most"))
    asked = asked.select(tile("bi").alias("ai"), tile("bj").alias("aj"), "i", "j").distinct()
    asked = asked.filter((tile("i") != F.col("ai")) | (tile("j") != F.col("aj")))
    seen_from = F.when(tile("j") < F.col("aj"), 1).when(tile("j") > F.col("aj"), 2).when(tile("i") < F.col("ai"), 4).otherwise(8)
    others = asked.withColumn("from", seen_from).join(own.filter("ways > 0"), ["i", "j"]).filter(F.col("ways").bitwiseAND(F.col("from")) != 0)
    others = others.select(F.col("ai").alias("ti"), F.col("aj").alias("tj"), F.lit(0).alias("part"), *ENDS, "i", "j", F.lit(15).alias("ways"))
    met = written(own.union(others), "met")
    discard(own, filled)
    return met


def border_distance(points: DataFrame, sides: DataFrame, x: Column, y: Column, cell: float = 8.0) -> DataFrame:
    """points (r, c and others) with the distance to the nearest side; infinite where there are no sides.

    Points are taken by tiles of blocks of cell x cell, and meet the sides that met_sides() sends there."""
    p = points.select("r", "c", x.cast("double").alias("px"), y.cast("double").alias("py"))
    p = p.dropna(subset=["px", "py"]).withColumns({"bi": F.floor(F.col("px") / cell).cast("long"), "bj": F.floor(F.col("py") / cell).cast("long")})
    p = p.withColumns({"ti": F.floor(F.col("bi") / TILE).cast("long"), "tj": F.floor(F.col("bj") / TILE).cast("long")})
    sides = sides.select(*[F.col(k).cast("double").alias(k) for k in ENDS]).dropna().distinct()
    tasks = points.sparkSession.sparkContext.defaultParallelism
    blocks = written(p.select("bi", "bj").distinct().repartition(tasks, "bi", "bj"), "blocks")
    met = met_sides(blocks.repartition(tasks, "bi", "bj"), sides, cell)
    if met is None:
        return points.withColumn("distance", F.lit(float("inf")))
    discard(blocks)
    parts = met.groupBy("ti", "tj").agg(F.max("part").alias("last"))
    p = p.join(parts, ["ti", "tj"], "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("part")).drop("last")

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        return pa.table({"r": own.column("r"), "c": own.column("c"), "distance": _nearest(own, other, cell) if own.num_rows else pa.array([], pa.float64())})

    key, kind = ["ti", "tj", "part"], dict(points.dtypes)
    found = p.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(run, f"r {kind['r']}, c {kind['c']}, distance double")
    best = found.groupBy("r", "c").agg(F.min("distance").alias("distance"))
    return points.join(best, ["r", "c"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
