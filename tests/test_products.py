"""Comparison products, catalogue, sparse gradients and circles, against numpy and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def grid(spark, arrays, keep=None):
    (first, *_) = arrays.values()
    rows = [(r, k, *(None if np.isnan(a[r, k]) else float(a[r, k]) for a in arrays.values())) for r, k in np.ndindex(first.shape) if keep is None or keep[r, k]]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{n} double" for n in arrays))


def test_p_of_correlations(spark):
    from rasterloom.operators.compare import correlation_p, t_test_p

    cases = [(r, n) for r in (0.0, 0.01, -0.2, 0.5, 0.9, -0.999, 1.0) for n in (3, 4, 10, 57, 1000, 40_000)]
    got = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long").withColumn("p", correlation_p(F.col("r"), F.col("n"))).collect()
    for x in got:
        want = 1.0 if x["r"] == 0 else t_test_p(x["r"], x["n"])
        assert math.isclose(x["p"], want, rel_tol=1e-9, abs_tol=1e-300), (x, want)
    # n = 4: two degrees of freedom, where the distribution has a closed form
    p = {(x["r"], x["n"]): x["p"] for x in got}
    t = 0.5 * math.sqrt(2 / (1 - 0.25))
    assert math.isclose(p[0.5, 4], 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9)
    assert spark.range(1).select(correlation_p(F.lit(0.3), F.lit(2))).head()[0] is None


def test_ssim_is_cut_to_the_overlap(spark):
    from rasterloom.operators.compare import ssim

    rng = np.random.default_rng(5)
    a, b = rng.uniform(1, 2, (30, 26)), rng.uniform(1, 2, (30, 26))
    b = (a + b) / 2
    ok = rng.random(a.shape) < 0.8
    ok[:4], ok[27:], ok[:, :3], ok[:, 22:] = False, False, False, False
    a[0, 0], b[29, 25] = np.nan, np.nan
    r, c = np.where(ok)
    x, y = (np.where(ok, v, v[ok].mean())[r.min() : r.max() + 1, c.min() : c.max() + 1] for v in (a, b))
    span, total = y.max() - y.min(), []
    for i in range(3, x.shape[0] - 3):
        for j in range(3, x.shape[1] - 3):
            p, q = (v[i - 3 : i + 4, j - 3 : j + 4].ravel() for v in (x, y))
            c1, c2, cov = (0.01 * span) ** 2, (0.03 * span) ** 2, np.cov(p, q)
            total.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    df = grid(spark, {"a": a, "b": b, "ok": ok.astype(float)})
    assert abs(ssim(df, a.shape, F.col("ok") == 1).head()[0] - np.mean(total)) < 1e-9


def test_gradient_next_to_missing_pixels(spark):
    from rasterloom.operators.focal import gradient

    z = np.arange(6.0)[:, None] + 10 * np.arange(5.0)[None, :]
    keep = np.ones(z.shape, bool)
    keep[2, 1] = keep[4, 3] = False
    got = {(x["r"], x["c"]): (x["gy"], x["gx"]) for x in gradient(grid(spark, {"z": z}, keep), "z", 1.0, 1.0).collect()}
    for (r, k), (gy, gx) in got.items():
        up, down = [bool(keep[i, k]) if 0 <= i < 6 else None for i in (r - 1, r + 1)]
        left, right = [bool(keep[r, i]) if 0 <= i < 5 else None for i in (k - 1, k + 1)]
        assert gy == (1.0 if up is not False and down is not False else None), (r, k)
        assert gx == (10.0 if left is not False and right is not False else None), (r, k)


def test_samples_of_equal_points_and_of_points_with_nulls(spark):
    from rasterloom.operators.resample import sampled

    v = np.arange(20.0).reshape(4, 5)
    points = [(0.5, 1.5, "a"), (0.5, 1.5, "a"), (0.5, 1.5, None), (9.0, 0.0, "out"), (None, 1.0, "null"), (3.0, 4.0, "corner")]
    p = spark.createDataFrame(points, "y double, x double, tag string")
    got = sorted((r["tag"] or "", r["v"] is None, r["v"] or 0.0) for r in sampled(p, grid(spark, {"v": v}), "v", F.col("y"), F.col("x"), 4, 5).collect())
    assert got == [("", False, 4.0), ("a", False, 4.0), ("a", False, 4.0), ("corner", False, 19.0), ("null", True, 0.0), ("out", True, 0.0)]


def test_circles_by_tiles(spark):
    from rasterloom.operators.joins import in_circles

    rng = np.random.default_rng(2)
    circles = [(f"n{i}", int(rng.integers(-5, 45)), int(rng.integers(-5, 35)), int(rng.integers(0, 20))) for i in range(12)]
    g = grid(spark, {"v": rng.random((40, 30))})
    got = sorted((x["crater"], x["r"], x["c"]) for x in in_circles(g, spark.createDataFrame(circles, "crater string, r0 int, c0 int, radius int"), tile=8).collect())
    assert got == sorted((n, r, k) for n, r0, c0, q in circles for r, k in np.ndindex(40, 30) if (r - r0) ** 2 + (k - c0) ** 2 <= q * q)


def test_catalogue_borrows_and_compares(spark):
    from rasterloom.sources.rasters import Frame, catalog, consistent

    a, b = Frame("plane", 5.0, 9.0, 2.0), Frame("", 5.0, 9.0, 2.0, -1.0)
    v = grid(spark, {"v": np.arange(12.0).reshape(3, 4)})
    both = catalog({"x": v, "y": v}, {"x": a, "y": b}, a)
    rows = {r["band"]: r for r in both.collect()}
    assert rows["y"]["crs"] == "plane" and rows["y"]["nodata"] == -1.0 and rows["x"]["nodata"] is None
    assert (rows["x"]["left"], rows["x"]["bottom"], rows["x"]["right"], rows["x"]["top"]) == (5.0, 3.0, 13.0, 9.0)
    assert consistent(both).head()["same"]
    moved = consistent(catalog({"x": v, "y": v}, {"x": a, "y": Frame("plane", 6.0, 9.0, 2.0)}, a)).head()
    assert not moved["same"] and moved["same_size"]


def test_writes_of_several_threads_leave_the_session_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from rasterloom.sources import shared

    before = spark.conf.get(shared._CLEAN)
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda n: shared.written(spark.range(n), "threads"), range(1, 9)))
    assert [t.count() for t in tables] == list(range(1, 9)) and spark.conf.get(shared._CLEAN) == before
    assert not shared._writing
    shared.discard(*tables)


def test_no_folder_of_our_own_on_a_cluster():
    from rasterloom.sources.shared import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_decomposition_equals_a_solver(spark):
    from rasterloom.operators.eigen import T3, decomposition

    rng = np.random.default_rng(4)
    looks = rng.normal(size=(400, 3, 9)) + 1j * rng.normal(size=(400, 3, 9))
    looks[:100, :, 3:] = 0  # of full rank still
    looks[100:150] *= 1e-4
    m = looks @ looks.conj().transpose(0, 2, 1)
    rows = [(i, 0, *(float(x[k, k].real) for k in range(3)), *(float(f(x[j, k])) for j, k in ((0, 1), (0, 2), (1, 2)) for f in (np.real, np.imag))) for i, x in enumerate(m)]
    rows += [(1000, 0, None, *[1.0] * 8), (1001, 0, *[0.0] * 9), (1002, 0, 2.0, 1.0, 1.0, *[0.0] * 6)]
    got = {x["r"]: x for x in decomposition(spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{t} double" for t in T3))).collect()}
    values, vectors = np.linalg.eigh(m)
    p = np.clip(values / values.sum(axis=1, keepdims=True), 1e-12, 1)
    alpha = (p * np.degrees(np.arccos(np.clip(np.abs(vectors[:, 0, :]), 0, 1)))).sum(axis=1)
    for i in range(len(m)):
        want = (-(p[i] * np.log(p[i])).sum() / np.log(3), (p[i, 1] - p[i, 0]) / (p[i, 1] + p[i, 0]), alpha[i])
        assert np.allclose([got[i]["entropy"], got[i]["anisotropy"], got[i]["alpha"]], want, atol=1e-7), i
    assert all(got[1000][k] is None for k in ("entropy", "anisotropy", "alpha"))
    assert all(abs(got[1001][k]) < 1e-6 for k in ("entropy", "anisotropy", "alpha"))
    assert abs(got[1002]["alpha"] - 45) < 1e-4 and abs(got[1002]["anisotropy"]) < 1e-6  # two equal ones at 90 degrees


def test_alignment_gives_the_weight_of_gaps_to_the_others(spark):
    from rasterloom.operators.resample import aligned
    from rasterloom.sources.rasters import Frame

    v = np.array([[1.0, 2.0, 3.0], [np.nan, 5.0, 6.0]])
    at = [(0, 0, 1.0, 3.0), (0, 1, 2.0, 2.0), (0, 1, 2.0, 2.0), (0, 2, 0.2, 3.8), (0, 3, 9.0, 3.0), (0, 4, 0.5, 0.5), (0, 5, None, 1.0)]
    t = spark.createDataFrame(at, "r int, c int, x double, y double")
    out = aligned(t, grid(spark, {"v": v}), "v", Frame("plane", 0.0, 4.0, 2.0), (2, 3), 10.0).collect()
    got = sorted((x["c"], x["v"]) for x in out if x["v"] is not None)
    # centres: (1, 3), (3, 3), ...; at (2, 2) the four are 1, 2, none and 5
    assert got == [(0, 10.0), (1, pytest.approx(80 / 3)), (1, pytest.approx(80 / 3)), (2, 10.0)]
    assert sorted(x["c"] for x in out if x["v"] is None) == [3, 4, 5]
    near = aligned(t, grid(spark, {"v": v}), "v", Frame("plane", 0.0, 4.0, 2.0), (2, 3), 1.0, True)
    assert sorted((x["c"], x["v"]) for x in near.collect() if x["v"] is not None) == [(0, 1.0), (1, 5.0), (1, 5.0), (2, 1.0)]


def test_a_warp_that_fills_too_little_gives_way(spark):
    from rasterloom.operators.resample import filled_or, separable_warp

    v = np.arange(12.0).reshape(3, 4)
    src = grid(spark, {"v": v}).withColumns({"x": F.col("c") * 2.0, "y": F.col("r") * 2.0})
    cells = spark.createDataFrame([(i, j, j * 1.0, i * 1.0) for i in range(4) for j in range(6)], "r int, c int, x double, y double")
    inverse = lambda: separable_warp(src, cells, "v", 3, 4)
    first = spark.createDataFrame([(0, 0, 7.0)] * 5, "r int, c int, v double")
    assert filled_or(first, 1000, inverse).count() == 5 and filled_or(first.limit(0), 0, inverse).count() == 0
    got = {(x["r"], x["c"]): x["v"] for x in filled_or(first, 1001, inverse).collect()}
    assert got == {(i, j): i / 2 * 4 + j / 2 for i in range(4) for j in range(6)}
