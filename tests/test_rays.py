"""Ray operators against loop kernels on tiny grids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import ray_pyramid, ray_tiles, rays

MOON = 1_737_400.0


def grid(spark, z, psr):
    rows = [(r, k, float(z[r][k]), int(psr[r][k])) for r in range(len(z)) for k in range(len(z[0]))]
    return spark.createDataFrame(rows, "r int, c int, z double, psr int")


def line(angle, n_angles, most):
    """Offsets of one ray by the error-accumulating line algorithm."""
    rad = 2 * math.pi * angle / n_angles
    er, ec = round(most * math.sin(rad)), round(most * math.cos(rad))
    long, short = max(abs(er), abs(ec)), min(abs(er), abs(ec))
    err, minor, out = 2 * short - long, 0, []
    for k in range(1, long + 1):
        if err >= 0:
            minor, err = minor + 1, err - 2 * long
        err += 2 * short
        a, b = (minor, k) if abs(ec) >= abs(er) else (k, minor)
        out.append((a * (1 if er >= 0 else -1), b * (1 if ec >= 0 else -1)))
    return out


def shadowed_by_loop(z, psr, n_angles, most, cell=20.0):
    h, w, out = len(z), len(z[0]), set()
    table = [line(a, n_angles, most) for a in range(n_angles)]
    for r in range(h):
        for k in range(w):
            if not psr[r][k]:
                continue
            sees = False
            for ray in table:
                top = -1e18
                for dr, dc in ray:
                    y, x = r + dr, k + dc
                    if not (0 <= y < h and 0 <= x < w):
                        break
                    d = max(math.hypot(dr, dc) * cell, 1.0)
                    r1, r2 = MOON + z[r][k], MOON + z[y][x]
                    tan = r1 * (r2 - math.sqrt(d * d + r1 * r1)) / (d * r2)
                    if not psr[y][x] and tan >= top:
                        sees = True
                    top = max(top, tan)
            if not sees:
                out.add((r, k))
    return out


@pytest.mark.parametrize("n,most", [(8, 8), (16, 12), (12, 5), (360, 3)])
def test_bresenham_table(spark, n, most):
    got = {}
    for r in rays.bresenham_rays(spark, n, most).orderBy("a", "k").collect():
        got.setdefault(r["a"], []).append((r["dr"], r["dc"]))
    assert got == {a: line(a, n, most) for a in range(n)}


@pytest.mark.parametrize("seed,near", [(1, 1), (2, 3), (3, 12)])
def test_doubly_shadowed(spark, seed, near):
    rng = random.Random(seed)
    z = [[rng.uniform(0, 60) for _ in range(18)] for _ in range(16)]
    psr = [[int(rng.random() < 0.9) for _ in range(18)] for _ in range(16)]
    want = shadowed_by_loop(z, psr, 16, 12)
    g = grid(spark, z, psr)
    got = {(r["r"], r["c"]) for r in rays.doubly_shadowed(g, rays.bresenham_rays(spark, 16, 12), near).collect()}
    assert got == want and want
    tiled = ray_pyramid.doubly_shadowed(g, ray_tiles.bresenham_table(16, 12), tile=7, block=3)
    assert {(r["r"], r["c"]) for r in tiled.collect()} == want


@pytest.mark.parametrize("case,want", [("visible", 0), ("blocked", 1), ("dark", 1)])
def test_line_of_sight_fixtures(spark, case, want):
    """A lit hilltop is seen; a ridge hides it; nothing lit cannot be seen."""
    z = [[0.0] * 5 for _ in range(5)]
    lit = [[0] * 5 for _ in range(5)]
    if case != "dark":
        z[2][0], lit[2][0] = 5.0, 1
    if case == "blocked":
        z[2][1] = 10.0
    g = grid(spark, z, [[1] * 5 for _ in range(5)]).join(spark.createDataFrame([(r, k, lit[r][k]) for r in range(5) for k in range(5)], "r int, c int, lit int"), ["r", "c"])
    west = spark.createDataFrame([(0, 1, 0, -1, 20.0), (0, 2, 0, -2, 40.0)], "a int, k int, dr int, dc int, dist double")
    got = rays.doubly_shadowed(g, west, 1, rays.flat_tan(), F.col("lit") == 1).filter("r = 2 and c = 2").count()
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_illumination(spark, seed):
    rng = random.Random(seed)
    z = [[rng.uniform(0, 80) for _ in range(14)] for _ in range(15)]
    azimuths, elevation, most = [17.0, 137.0, 250.0], 40.0, 6
    tan = math.tan(math.radians(elevation))
    dark = {}
    for r in range(15):
        for k in range(14):
            for az in azimuths:
                for s in range(1, most + 1):
                    dr, dc = round(-math.cos(math.radians(az)) * s), round(math.sin(math.radians(az)) * s)
                    if not (0 <= r + dr < 15 and 0 <= k + dc < 14):
                        break
                    if (z[r + dr][k + dc] - z[r][k]) / max(math.hypot(dr, dc) * 20, 1) >= tan:
                        dark[r, k] = dark.get((r, k), 0) + 1
                        break
    g = grid(spark, z, [[0] * 14] * 15)
    got = {(r["r"], r["c"]): (r["lit"], r["n_dark"]) for r in rays.illumination(g.select("r", "c", "z"), azimuths, elevation, most).collect()}
    assert got == {(r, k): (int(dark.get((r, k), 0) < 3), dark.get((r, k), 0)) for r in range(15) for k in range(14)}
    tiled = ray_pyramid.illumination(g.select("r", "c", "z"), azimuths, elevation, most, tile=6, block=2)
    assert {(r["r"], r["c"]): (r["lit"], r["n_dark"]) for r in tiled.collect()} == got


def hilly(h, w, seed):
    """Heights with hills some pixels wide."""
    import numpy as np

    z = np.random.default_rng(seed).normal(size=(h, w))
    for _ in range(6):
        z = (z + sum(np.roll(z, k, axis) for axis in (0, 1) for k in (1, -1))) / 5
    return z / z.std()


def cast_by_loop(z, there, goal, looks, table, tangent, sun=None):
    """Pixel -> azimuths along which it meets a goal (with a sun: a pixel at its tangent). A missing pixel ends a ray."""
    h, w = z.shape
    out = {}
    for r in range(h):
        for k in range(w):
            if not (there[r, k] and looks[r, k]):
                continue
            met = 0
            for dr, dc, dist in table:
                top = -1e18 if sun is None else sun
                for i, j, d in zip(dr, dc, dist):
                    y, x = r + i, k + j
                    if not (0 <= y < h and 0 <= x < w and there[y, x]):
                        break
                    tan = tangent(z[r, k], z[y, x], d)
                    if goal[y, x] and tan >= top:
                        met += 1
                        break
                    top = max(top, tan) if sun is None else top
            out[r, k] = met
    return out


def curved(z0, z1, d):
    return (MOON + z0) * (MOON + z1 - math.sqrt(d * d + (MOON + z0) ** 2)) / (d * (MOON + z1))


@pytest.mark.parametrize("seed,size,tile,block,holes", [(1, (48, 40), 16, 4, 0), (2, (40, 33), 13, 5, 0), (3, (36, 50), 7, 3, 5), (4, (30, 30), 64, 32, 3)])
def test_pyramid_equals_loops_over_whole_rays(spark, seed, size, tile, block, holes):
    """Rays of 2,500 steps, over many tiles, with pixels missing."""
    import numpy as np

    z, lit = hilly(*size, seed) * 40, hilly(*size, seed + 50) >= 0.9
    there, rng = np.ones(size, bool), random.Random(seed)
    for _ in range(holes):
        there[rng.randrange(size[0]), rng.randrange(size[1])] = False
    rows = [(r, c, float(z[r, c]), int(not lit[r, c])) for r in range(size[0]) for c in range(size[1]) if there[r, c]]
    g = spark.createDataFrame(rows, "r int, c int, z double, psr int").repartition(3).cache()
    table = ray_tiles.bresenham_table(12, 2500)
    for radius, tangent in ((MOON, curved), (None, lambda a, b, d: (b - a) / d)):
        met = cast_by_loop(z, there, lit, ~lit, ray_tiles.inside(table, *size), tangent)
        got = ray_pyramid.doubly_shadowed(g, table, tile, radius, shape=size, block=block).collect()
        want = {at for at, n in met.items() if not n}
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    azimuths = [360 * k / 10 for k in range(10)]
    for elevation in (4.0, 45.0):
        met = cast_by_loop(z, there, there, there, ray_tiles.inside(ray_tiles.sun_table(azimuths, 2500), *size), lambda a, b, d: (b - a) / d, math.tan(math.radians(elevation)))
        got = ray_pyramid.illumination(g.select("r", "c", "z"), azimuths, elevation, 2500, tile, shape=size, block=block).collect()
        assert {(x["r"], x["c"]): x["n_dark"] for x in got} == met and all(x["lit"] == (x["n_dark"] < 10) for x in got)
    g.unpersist()


def test_pyramid_of_no_and_of_flat_ground(spark):
    empty = spark.createDataFrame([], "r int, c int, z double, psr int")
    assert ray_pyramid.doubly_shadowed(empty, ray_tiles.bresenham_table(8, 5)).count() == 0
    assert ray_pyramid.illumination(empty, [0.0], 5.0, 5).count() == 0
    flat = spark.createDataFrame([(r, c, 5.0, int(c > 0)) for r in range(20) for c in range(90)], "r int, c int, z double, psr int")
    table = ray_tiles.bresenham_table(8, 100)
    assert ray_pyramid.doubly_shadowed(flat, table, 16, None, block=4).count() == 0  # over a plane the lit edge is seen
    assert {r["n_dark"] for r in ray_pyramid.illumination(flat.select("r", "c", "z"), [90.0, 200.0], 1.0, 100, 16, block=4).collect()} == {0}


def test_pyramid_sends_rows_that_do_not_grow_with_reach(spark):
    """Behind a near crest nothing of a far plain is asked for."""
    from rasterloom.operators.ray_pyramid import Cast, Sight, _first, _pixels

    ridges = [(r, c, 300.0 if c % 16 == 8 else 0.0, int(c % 16 != 8)) for r in range(64) for c in range(512)]
    g = spark.createDataFrame(ridges, "r int, c int, z double, psr int").cache()
    goal, looks = F.lit(True), F.col("psr") == 1
    n = []
    for reach in (64, 500):
        table = ray_tiles.inside(ray_tiles.sun_table([90.0, 137.0, 240.0], reach), 64, 512)
        cast = Cast(table, Sight(None, math.tan(math.radians(30.0))), (64, 512), 64, 8)
        n.append(_first(_pixels(g, 64, goal, looks), cast, True).filter("tr is not null").count())
    assert n[1] <= 1.2 * n[0] and n[1] < 0.5 * 3 * 64 * 512, n  # of all rays
    g.unpersist()


def test_shadow_is_inside_the_mask(spark):
    from rasterloom.plans import registry

    assert registry.queries()["K2_subset_check"](spark, "/root/testdata/sf0.001").first()["n_outside"] == 0
