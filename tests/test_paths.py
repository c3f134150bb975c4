"""Least-cost paths against a plain search, and against recursive SQL."""

import functools
import heapq
import math

import numpy as np
import pytest

from rasterloom.operators import paths
from tests.oracle import duck

SF = "/root/testdata/sf0.001"


def table(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "r int, c int, cost double").repartition(3)


def least(z, start, goal):
    d, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        at, (r, c) = heapq.heappop(heap)
        if at > d[r, c]:
            continue
        if (r, c) == goal:
            return at
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                q = (r + a, c + b)
                if (a or b) and 0 <= q[0] < z.shape[0] and 0 <= q[1] < z.shape[1] and z[q] > 0:
                    new = at + math.hypot(a, b) * (z[r, c] + z[q]) / 2
                    if new < d.get(q, math.inf):
                        d[q] = new
                        heapq.heappush(heap, (new, q))
    return None


def check(spark, z, start, goal, tile):
    rows = paths.least_path(table(spark, z), start, goal, tile).orderBy("k").collect()
    want = least(z, start, goal)
    if want is None:
        assert not rows
        return
    assert [r["k"] for r in rows] == list(range(len(rows)))
    assert (rows[0]["r"], rows[0]["c"], rows[0]["dist"]) == (*start, 0.0) and (rows[-1]["r"], rows[-1]["c"]) == goal
    assert abs(rows[-1]["dist"] - want) < 1e-9
    for a, b in zip(rows, rows[1:]):  # neighbours, each at the cost of its step
        dr, dc = b["r"] - a["r"], b["c"] - a["c"]
        assert max(abs(dr), abs(dc)) == 1
        assert abs(b["dist"] - a["dist"] - math.hypot(dr, dc) * (z[a["r"], a["c"]] + z[b["r"], b["c"]]) / 2) < 1e-9


@pytest.mark.parametrize("seed,tile", [(1, 5), (2, 7), (3, 64)])
def test_paths_equal_a_plain_search(spark, seed, tile):
    z = np.random.default_rng(seed).uniform(1, 30, (23, 18)) ** 1.5
    check(spark, z, (0, 0), (22, 17), tile)
    check(spark, z, (11, 9), (12, 3), tile)


def test_walls_gaps_and_places_that_cannot_be_reached(spark):
    z = np.ones((16, 16))
    z[:, 8] = np.nan
    z[4, 2:8] = 0.0  # cannot be entered either
    check(spark, z, (0, 0), (15, 15), 5)  # no way
    z[13, 8] = 2.0
    check(spark, z, (0, 0), (0, 15), 5)  # through the gap
    check(spark, z, (3, 3), (3, 3), 5)
    for start, goal in (((0, 0), (3, 8)), ((0, 0), (99, 0)), ((4, 3), (0, 0))):
        assert paths.least_path(table(spark, z), start, goal, 5).count() == 0
    assert paths.least_path(table(spark, z).limit(0), (0, 0), (1, 1)).count() == 0


def test_path_cost_equals_recursive_sql(spark):
    z = np.random.default_rng(5).integers(1, 20, (7, 6)).astype(float)
    con = duck(SF)
    con.execute("CREATE TABLE g AS SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {z[r, c]}::DOUBLE)" for r, c in np.ndindex(z.shape)) + ") t(r, c, cost)")
    (want,) = con.execute("""WITH RECURSIVE e AS (SELECT a.r * 6 + a.c AS x, b.r * 6 + b.c AS y, sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2) * (a.cost + b.cost) / 2 AS w
FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)),
p AS (SELECT 0 AS n, 0 AS x, 0.0::DOUBLE AS d UNION ALL SELECT n, x, d FROM (SELECT n + 1 AS n, y AS x, min(d + w) AS d FROM p JOIN e USING (x) WHERE n < 41 GROUP BY n, y))
SELECT min(d) FROM p WHERE x = 41""").fetchone()
    con.close()
    got = paths.least_path(table(spark, z), (0, 0), (6, 5), 3).orderBy("k").collect()
    assert abs(got[-1]["dist"] - want) < 1e-9
    check(spark, z, (0, 0), (6, 5), 3)


def test_only_borders_move_after_the_first_pass(spark):
    z = np.ones((40, 40))
    edges = paths.border_graph(table(spark, z), [(0, 0), (39, 39)], 10)
    nodes = edges.select("r", "c").distinct().count()
    assert nodes == 16 * 36 and edges.filter("r % 10 between 1 and 8 and c % 10 between 1 and 8").count() == 0


def test_the_registered_path(spark):
    from rasterloom.plans import registry

    rows = registry.queries()["I3_rover_path"](spark, SF).orderBy("k").collect()
    h = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert (rows[0]["r"], rows[0]["c"], rows[-1]["r"], rows[-1]["c"]) == (0, 0, h - 1, 63) and len(rows) >= h
    assert all(max(abs(a["r"] - b["r"]), abs(a["c"] - b["c"])) == 1 and a["dist"] < b["dist"] for a, b in zip(rows, rows[1:]))


def test_tiles_of_a_long_strip_are_joined(spark, monkeypatch):
    """Forty tiles in a row took a round each; joined, their ends are one step apart."""
    z = np.random.default_rng(6).uniform(1, 9, (160, 4))
    z[70, 1:] = np.nan
    z[75:78, 0] = np.nan
    rounds, write = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, what: rounds.append(what) or write(df, what))
    check(spark, z, (0, 0), (159, 3), 4)
    assert 0 < rounds.count("reached") < 6


@pytest.mark.parametrize("most", [0, 44])
def test_regions_are_joined_up_to_a_bound(spark, monkeypatch, most):
    z = np.random.default_rng(8).uniform(1, 30, (40, 44)) ** 1.5
    z[10:30, 12] = z[25, 3:20] = np.nan
    monkeypatch.setattr(paths, "least_path", functools.partial(paths.least_path, most=most))
    check(spark, z, (1, 2), (33, 41), 5)
    check(spark, z, (26, 13), (24, 11), 5)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (6, 1), (5, 8), (13, 6)])
def test_borders_of_an_array_equal_a_plain_search(shape):
    z = np.random.default_rng(9).uniform(1, 30, (2, *shape)) ** 1.5
    z[1, 0, shape[1] // 2] = np.inf
    y, x = paths._border(*shape)
    for costs, d in zip(z, paths._closure(z)):
        costs = np.where(np.isinf(costs), np.nan, costs)
        for i, j in np.ndindex(d.shape):
            ends = (int(y[i]), int(x[i])), (int(y[j]), int(x[j]))
            if not any(np.isnan(costs[e]) for e in ends):
                want = least(costs, *ends)
                assert d[i, j] == (math.inf if want is None else pytest.approx(want, abs=1e-9))
