"""Polygon tables: coverage and nearest sides against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import polygons

SIDES = "poly int, x1 double, y1 double, x2 double, y2 double"


def ring(poly, points):
    return [(poly, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def grid(spark, h, w):
    return spark.range(h * w).select((F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))


def by_numpy(sides, h, w):
    """inside and distance of every pixel's centre."""
    y, x = (np.indices((h, w)) + 0.5).reshape(2, -1)
    inside, far = np.zeros(h * w, bool), np.full(h * w, np.inf)
    parity = {}
    for poly, x1, y1, x2, y2 in sides:
        at = (y1 > y) != (y2 > y)
        if y1 != y2:
            hit = at & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
            parity[poly] = parity.get(poly, False) ^ hit
        dx, dy = x2 - x1, y2 - y1
        t = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0.0
        far = np.minimum(far, np.hypot(x - x1 - t * dx, y - y1 - t * dy))
    for hit in parity.values():
        inside |= hit
    return inside.reshape(h, w), far.reshape(h, w)


def check(spark, sides, h, w, cell=8.0):
    df = spark.createDataFrame(sides, SIDES).repartition(3)
    inside, far = by_numpy(sides, h, w)
    got = polygons.covered(grid(spark, h, w), df).collect()
    assert len(got) == h * w and all(bool(r["inside"]) == inside[r["r"], r["c"]] for r in got)
    near = polygons.border_distance(grid(spark, h, w), df, F.col("c") + 0.5, F.col("r") + 0.5, cell).collect()
    assert len(near) == h * w and all(abs(r["distance"] - far[r["r"], r["c"]]) < 1e-9 for r in near)


def test_square_triangle_and_crossed_sides(spark):
    sides = ring(0, [(1.2, 0.7), (9.5, 3.1), (4.4, 9.9)]) + ring(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]) + ring(2, [(6.1, 6.2), (9.0, 6.2), (6.1, 9.7), (9.0, 9.7)])
    check(spark, sides, 12, 11, 2.0)


def test_holes_parts_and_degenerate_sides(spark):
    sides = ring(0, [(-5.0, -5.0), (30.0, -4.0), (28.0, 30.0), (-3.0, 29.0)]) + ring(0, [(5.0, 5.0), (9.5, 5.0), (9.5, 12.0), (5.0, 12.0)])  # a hole, and sides off the grid
    sides += ring(0, [(40.0, 3.0), (47.5, 3.0), (44.0, 20.0)]) + [(1, 33.3, 33.3, 33.3, 33.3)]  # another part, and a point
    sides += ring(2, [(60.2, 1.1), (60.2, 1.1), (61.0, 9.0)])
    check(spark, sides, 36, 64)
    check(spark, sides, 36, 64, 3.0)


def test_one_far_polygon_and_a_long_side(spark):
    check(spark, ring(0, [(4000.0, 5000.0), (4010.0, 5000.0), (4000.0, 5020.0)]), 20, 30)
    check(spark, ring(0, [(-3000.0, 7.25), (3000.0, 7.75), (3000.0, 9.75)]), 20, 30)


def test_no_sides_and_no_pixels(spark):
    none = spark.createDataFrame([], SIDES)
    got = polygons.border_distance(grid(spark, 3, 4), none, F.col("c") + 0.5, F.col("r") + 0.5).collect()
    assert {r["distance"] for r in got} == {float("inf")} and len(got) == 12
    assert {r["inside"] for r in polygons.covered(grid(spark, 3, 4), none).collect()} == {0}
    one = spark.createDataFrame(ring(0, [(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)]), SIDES)
    assert polygons.border_distance(grid(spark, 0, 1), one, F.col("c") + 0.5, F.col("r") + 0.5).count() == 0
    assert polygons.covered(grid(spark, 0, 1), one).count() == 0


@pytest.mark.parametrize("stacked", [False, True])
def test_ten_thousand_polygons(spark, stacked):
    """Spread over the grid, or a third of them at one place; joins on cells only, no literal and no nested loop."""
    rng = np.random.default_rng(7)
    h, w, sides = 160, 64, []
    for k in range(10_000):
        x, y = (20.3, 70.9) if stacked and k % 3 == 0 else (rng.uniform(0, w), rng.uniform(0, h) * (0.5 if stacked else 1))
        turn = np.sort(rng.uniform(0, 2 * np.pi, 3))
        sides += ring(k, [(x + 0.2 * np.cos(t), y + 0.2 * np.sin(t)) for t in turn])
    df = spark.createDataFrame(sides, SIDES)
    out = polygons.border_distance(grid(spark, h, w), df, F.col("c") + 0.5, F.col("r") + 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and len(plan) < 200_000
    check(spark, sides, h, w)


def test_dense_lines_send_only_what_is_seen(spark):
    """Polygons along two lines far apart, as the query has them at size: tiles between meet a small share of the sides, and the nearest."""
    rng, h, w, sides = np.random.default_rng(3), 200, 64, []
    for k in range(4_000):
        x, y = rng.uniform(0, w), (3.3, 194.6)[k % 2]
        turn = np.sort(rng.uniform(0, 2 * np.pi, 4))
        sides += ring(k, [(x + 1.2 * np.cos(t), y + 1.2 * np.sin(t)) for t in turn])
    df = spark.createDataFrame(sides, SIDES).repartition(3)
    blocks = grid(spark, h // 8, w // 8).select(F.col("c").cast("long").alias("bi"), F.col("r").cast("long").alias("bj"))
    met = polygons.met_sides(blocks, df.select(*polygons.ENDS), 8.0)
    between = met.filter("tj in (1, 2)").count()
    assert 0 < between < 2 * len(sides) // 4  # of two tiles, each near both lines
    y, x = (np.indices((h, w)) + 0.5).reshape(2, -1)[:, ::97]
    x1, y1, x2, y2 = np.array(sides).T[1:]
    t = np.clip(((x[:, None] - x1) * (x2 - x1) + (y[:, None] - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
    far = np.hypot(x[:, None] - x1 - t * (x2 - x1), y[:, None] - y1 - t * (y2 - y1)).min(1)
    got = {(r["r"], r["c"]): r["distance"] for r in polygons.border_distance(grid(spark, h, w), df, F.col("c") + 0.5, F.col("r") + 0.5).collect()}
    assert len(got) == h * w and all(abs(got[int(b), int(a)] - d) < 1e-9 for a, b, d in zip(x, y, far))


def test_parts_of_a_tile_and_points_at_one_place(spark, monkeypatch):
    monkeypatch.setattr(polygons, "PART", 7)
    monkeypatch.setattr(polygons, "ROOM", 16)
    rng = np.random.default_rng(5)
    sides = [(k, *rng.uniform(0, 30, 4).tolist()) for k in range(60)] + [(60, 8.0, 0.0, 8.0, 16.0), (61, 0.0, 16.0, 24.0, 16.0)]
    _, far = by_numpy(sides, 40, 33)
    df = spark.createDataFrame(sides, SIDES)
    for one in (False, True):
        x, y = (F.lit(20.5), F.lit(20.5)) if one else (F.col("c") + 0.5, F.col("r") + 0.5)
        got = polygons.border_distance(grid(spark, 40, 33), df, x, y).collect()
        assert len(got) == 40 * 33
        assert all(abs(r["distance"] - (far[20, 20] if one else far[r["r"], r["c"]])) < 1e-9 for r in got)
