"""As-of joins, control-point fits and separable warps against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import control_points, resample
from rasterloom.operators.asof import asof


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", ["1", "7"])
def test_asof_equals_search(spark, parts):
    rng = np.random.default_rng(1)
    keys = [(float(m), k) for k, m in enumerate(rng.integers(0, 400, 300) / 4)] + [(float("nan"), 900), (None, 901)]
    asked = sorted({float(v) for v in rng.integers(-20, 480, 500) / 4}) + [None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = asof(spark.createDataFrame([(v,) for v in asked], "v double"), spark.createDataFrame(keys, "m double, k int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((m, k) for m, k in keys if m is not None and m == m)
    want = {}
    for v in asked[:-1]:
        low = [x for x in order if x[0] <= v]
        high = [x for x in order if x[0] > v]
        want[v] = (*(low[-1] if low else (None, None)), *(high[0] if high else (None, None)))
    assert {r["v"]: (r["m"], r["k"], r["m2"], r["k2"]) for r in got} == want and len(got) == len(want)


def test_asof_reads_no_frame_again_for_every_row(spark):
    v, k = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([(1.0, 2), (3.0, 4)], "m double, k int")
    out = asof(v, k)
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0, 2, 3.0, 4)]
    assert "unboundedfollowing" not in plan(out)


def test_asof_of_empty_sides(spark):
    v, k = spark.createDataFrame([(1.0,)], "v double"), spark.createDataFrame([(1.0, 2)], "m double, k int")
    assert [tuple(r) for r in asof(v, k.limit(0)).collect()] == [(1.0, None, None, None, None)]
    assert asof(v.limit(0), k).count() == 0


def test_asof_of_a_whole_scene_is_linear(spark):
    """272,631 lines, each asked for; neither a nested loop nor a single task for all."""
    lines = spark.range(272_631)
    out = asof(lines.select((F.col("id") * 2.0 + 0.5).alias("v")), lines.select((F.col("id") * 2.0).alias("m"), F.col("id").alias("k")))
    assert "NestedLoop" not in plan(out) and "SinglePartition" not in plan(out)
    began = time.perf_counter()
    n, off = out.agg(F.count(F.lit(1)), F.sum(F.abs(F.col("k") * 2.0 + 0.5 - F.col("v")))).first()
    assert (n, off) == (272_631, 0.0) and time.perf_counter() - began < 60


def test_separable_warp_plan_and_descending_lines(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(12, 9))
    rows = [(r, c, float(z[r, c]), c * 10.0, 500 - r * 10.0) for r in range(12) for c in range(9)]
    src = spark.createDataFrame(rows, "r int, c int, v double, x double, y double")
    target = spark.createDataFrame([(i, j, 4.0 * j, 390.0 + 5 * i) for i in range(23) for j in range(21)], "r int, c int, x double, y double")
    out = resample.separable_warp(src, target, "v", 12, 9)
    assert "NestedLoop" not in plan(out)
    got = {(r["r"], r["c"]): r["v"] for r in out.collect()}
    want = {}
    for i in range(23):
        for j in range(21):
            fr, fc = (500 - (390 + 5 * i)) / 10, 4 * j / 10
            if 0 < fr <= 11 and 0 <= fc < 8:  # the greatest mean has none above it
                a, b = int(fr), int(fc)
                at = lambda r, c: z[min(r, 11), min(c, 8)]
                want[i, j] = (at(a, b) * (1 - fc + b) + at(a, b + 1) * (fc - b)) * (1 - fr + a) + (at(a + 1, b) * (1 - fc + b) + at(a + 1, b + 1) * (fc - b)) * (fr - a)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_fit_equals_least_squares(spark, degree):
    rng = np.random.default_rng(degree)
    x, y = rng.uniform(1e5, 2e5, 200), rng.uniform(-3e6, -2.9e6, 200)
    r = 0.003 * (x - 1e5) + 1e-8 * (x - 1e5) * (y + 3e6) + rng.normal(size=200)
    c = 0.002 * (y + 3e6) - 2e-9 * (x - 1e5) ** 2 + rng.normal(size=200)
    points = spark.createDataFrame([tuple(map(float, p)) for p in zip(r, c, x, y)] + [(None, 1.0, 2.0, 3.0)], "r double, c double, x double, y double")
    fit = control_points.fitted(points, degree)
    got = control_points.residuals(points.dropna(), fit).orderBy("x").select("dr", "dc", "miss").collect()
    u, v = (x - fit.middle[0]) / fit.half[0], (y - fit.middle[1]) / fit.half[1]
    terms = np.stack([u**i * v**j for i, j in control_points.powers(degree)], 1)
    order = np.argsort(x)
    for name, z in (("dr", r), ("dc", c)):
        off = terms @ np.linalg.lstsq(terms, z, rcond=None)[0] - z
        assert np.allclose([q[name] for q in got], off[order], atol=1e-6)
    assert all(abs(q["miss"] - np.hypot(q["dr"], q["dc"])) < 1e-9 for q in got)


def test_fit_of_few_points(spark):
    assert control_points.fitted(spark.createDataFrame([], "r int, c int, x double, y double")) is None
    two = spark.createDataFrame([(0, 0, 0.0, 0.0), (4, 8, 10.0, 20.0)], "r int, c int, x double, y double")
    assert all(r["miss"] < 1e-6 for r in control_points.residuals(two, control_points.fitted(two, 3)).collect())
    with pytest.raises(ValueError):
        control_points.fitted(two, 4)


def test_control_point_warp_falls_back(spark, monkeypatch):
    """Control points that lie elsewhere fill nothing; the separable inverse is taken."""
    from rasterloom.plans import registry  # noqa: F401, I001
    from rasterloom.plans import geo

    sf = "/root/testdata/sf0.001"
    own = geo.controls
    monkeypatch.setattr(geo, "controls", lambda spark, d: own(spark, d).withColumns({"x": F.col("x") + 1e6, "y": F.col("y") + 1e6}))
    got = {(r["r"], r["c"]): r["v"] for r in geo.t7_warp(spark, sf).collect()}
    assert got == {(r["r"], r["c"]): r["v"] for r in geo.t8(spark, sf).collect()}


def test_resized_without_pixels(spark):
    assert resample.resized(spark.createDataFrame([], "r int, c int, v double"), "v", (3, 3), 5).count() == 0
