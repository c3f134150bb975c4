"""Streams over arriving tiles, bands that lie together, and nearest places on a sphere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scaling
from rasterloom.operators import joins, nearest
from rasterloom.plans import registry
from rasterloom.sources import derived
from rasterloom.streaming import tiles

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["r"], r["c"], None if r["score"] is None else round(r["score"], 9)) for r in df.collect())


def test_two_arrivals_and_a_repeated_batch(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    bands = derived.bands(spark, SF)
    lim = tiles.fixed_limits(bands)
    want = rows(scaling.confidence(bands))
    bands.filter("r < 200").repartition(2).write.parquet(source)
    scores = tiles.stream(spark, source, bands.schema, lim, files_per_batch=1)
    tiles.arrive(scores, out, mark)
    assert rows(spark.read.parquet(out)) == [x for x in want if x[0] < 200]
    bands.filter("r >= 200").write.mode("append").parquet(source)
    tiles.arrive(scores, out, mark)
    assert rows(spark.read.parquet(out)) == want
    tiles.arrive(scores, out, mark)  # nothing new
    assert rows(spark.read.parquet(out)) == want
    # the last batch was written, but the driver was lost before it was noted as done: it runs again
    done = sorted((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
        p.unlink(missing_ok=True)
    tiles.arrive(scores, out, mark)
    assert rows(spark.read.parquet(out)) == want
    other = str(tmp_path / "other")
    for n in (9, 1):  # a number's folder holds its last attempt alone
        tiles.keep(other)(spark.range(n), 77)
    assert spark.read.parquet(f"{other}/batch=77").count() == 1


def test_bucketed_bands_meet_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()["D1_bucketed_bands"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 7
        want = derived.bands(spark, SF).select("r", "c", "cpr", "dop", "tmean", "zit", "pump", "slope", "psr", "dpsr").dropna().count()
        assert df.count() == want > 0
        assert "Exchange" in joins.aligned([derived.bands(spark, SF).select("r", "c", x) for x in ("cpr", "dop")])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def far(a, b):
    p, q, u, v = map(math.radians, (*a, *b))
    s = math.sin((q - v) / 2)
    x = math.sin((u - p) / 2) ** 2 + math.cos(p) * math.cos(u) * s * s
    return 2 * 1737.4 * math.asin(min(math.sqrt(x), 1.0))


@pytest.mark.parametrize("seed,region,cell", [(1, (-90, -88), None), (2, (-90, 90), None), (3, (-3, 3), 0.3), (4, (88, 90), None)])
def test_nearest_on_a_sphere_equals_all_pairs(spark, seed, region, cell):
    rng = np.random.default_rng(seed)
    ties = [(k, float(rng.uniform(*region)), float(rng.uniform(-180, 180))) for k in range(300)]
    ties += [(900, ties[5][1], ties[5][2]), (901, -90.0, 12.0), (902, -90.0, -70.0), (903, float(region[0]), 180.0), (904, float(region[0]), -180.0), (905, None, 1.0)]
    places = [(r, k, float(rng.uniform(region[0] - 1, region[1])) if r else float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for r in range(12) for k in range(20)]
    places += [(50, 0, -90.0, 0.0), (50, 1, 90.0, 3.0), (50, 2, region[0] + 0.1, 179.999), (50, 3, region[0] + 0.1, -179.999), (51, 0, None, 3.0)]
    got = nearest.nearest_on_sphere(spark.createDataFrame(places, "r int, c int, lat double, lon double"), spark.createDataFrame(ties, "n int, lat double, lon double"), cell=cell)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["r"], r["c"]): (r["km"], r["n"]) for r in got.collect()}
    assert set(got) == {(r, c) for r, c, lat, _ in places if lat is not None}
    for r, c, lat, lon in places:
        if lat is not None:
            km, n = min((far((lat, lon), t[1:]), t[0]) for t in ties if t[1] is not None)
            assert abs(got[r, c][0] - km) < 2e-6
            assert got[r, c][1] == n or abs(far((lat, lon), next(t for t in ties if t[0] == got[r, c][1])[1:]) - km) < 2e-6


def test_nearest_on_a_sphere_of_empty_sides(spark):
    p = spark.createDataFrame([(0, 0, 1.0, 2.0)], "r int, c int, lat double, lon double")
    t = spark.createDataFrame([(7, 1.0, 3.0)], "n int, lat double, lon double")
    assert [tuple(r)[:3] for r in nearest.nearest_on_sphere(p, t).collect()] == [(0, 0, 7)]
    assert nearest.nearest_on_sphere(p, t.limit(0)).count() == 0 and nearest.nearest_on_sphere(p.limit(0), t).count() == 0


def test_ties_are_not_copied_for_levels_and_pixels_meet_few_chunks(spark):
    """Ties along meridians that meet at the pole, many of them at the same places: none is exploded, none broadcast."""
    rng = np.random.default_rng(9)
    ties = [(k, -90 + float(rng.exponential(1.0)), float(rng.integers(0, 1500)) * 2.4 - 180) for k in range(6000)]
    ties += [(6000 + k, *t[1:]) for k, t in enumerate(ties)]
    places = [(r, k, -90 + float(rng.exponential(1.0)), float(rng.uniform(-180, 180))) for r in range(10) for k in range(8)]
    t = spark.createDataFrame(ties, "n int, lat double, lon double")
    got = nearest.nearest_on_sphere(spark.createDataFrame(places, "r int, c int, lat double, lon double"), t)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Broadcast" not in plan
    got = {(r["r"], r["c"]): (r["km"], r["n"]) for r in got.collect()}
    assert len(got) == len(places)
    for r, c, lat, lon in places:
        km, n = min((round(far((lat, lon), t[1:]), 6), t[0]) for t in ties)
        assert abs(got[r, c][0] - km) < 2e-6 and got[r, c][1] < 6000
