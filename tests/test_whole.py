"""Queries that must cover the whole of their tables, against numpy and loops."""

import duckdb
import numpy as np

from rasterloom.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


def lines():
    return np.array([x for (x,) in duckdb.sql(f"SELECT embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()], np.float64)


def test_neighbourhood_of_every_pixel(spark):
    psr = (lines() < 0.1).astype(float)
    h, w = psr.shape
    got = {(r["r"], r["c"]): r for r in rows(spark, "F18_neighbourhood")}
    assert len(got) == h * w
    for (r, k), x in got.items():
        for half, name in ((10, "share"), (50, "share_101")):
            win = psr[max(0, r - half) : r + half + 1, max(0, k - half) : k + half + 1]
            assert abs(x[name] - win.mean()) < 1e-6


def test_polygons_and_optional_bands_reach_every_pixel(spark):
    want = {(r, k) for r, line in enumerate(lines()) for k in range(len(line))}
    for name in ("C13_polygon_distance", "D2_optional_bands"):
        got = [(r["r"], r["c"]) for r in rows(spark, name)]
        assert len(got) == len(want) and set(got) == want, name


def test_reach_of_every_shadowed_pixel(spark):
    v = lines()
    assert {(r["r"], r["c"]): r["reachable"] for r in rows(spark, "D11_reachable")} == {(int(r), int(k)): True for r, k in zip(*np.where(v < 0.1))}


def test_within_a_circle(spark):
    from pyspark.sql import functions as F

    from rasterloom.operators import joins

    rng = np.random.default_rng(8)
    for share, radius in ((0.02, 5), (0.01, 13), (0.0, 3)):
        lit = rng.random((30, 22)) < share
        g = spark.createDataFrame([(r, k, int(x)) for r, line in enumerate(lit) for k, x in enumerate(line)], "r int, c int, lit int")
        at = np.argwhere(lit)
        want = {(r, k): bool(len(at) and (((at - (r, k)) ** 2).sum(1) <= radius * radius).any()) for r in range(30) for k in range(22)}
        assert {(r["r"], r["c"]): r["within"] for r in joins.within(g, F.col("lit") == 1, radius).collect()} == want


def test_quick_compare_takes_all_pixels(spark):
    e = lines()
    at = lambda k: np.roll(e, -k, axis=1)
    cpr = np.where(at(5) <= 0.2, 0.4 + 2 * e, np.nan)
    official = np.where(at(57) <= 0.2, 0.5 + 1.6 * e + 0.6 * at(56), np.nan)
    ok = (cpr > 0) & (cpr <= 20) & (official > 0) & (official <= 20)
    (x,) = rows(spark, "G15_quick_compare")
    assert x["n"] == ok.sum() and ok.sum() > 10_000
    assert abs(x["r"] - np.corrcoef(cpr[ok], official[ok])[0, 1]) < 1e-6


def ties():
    got = duckdb.sql(f"SELECT -90 + value / 50, user_id * 2.4 - 180 FROM '{SF}/events.parquet' ORDER BY event_id").fetchall()
    n = len(got) // 9
    return np.array(got, np.float64)[: n * 9].reshape(n, 9, 2)


def test_ties_of_all_lines(spark):
    t, (h, w) = ties(), lines().shape
    n = len(t)
    got = {(x["i"], x["j"]): x for x in rows(spark, "T1_tie_grid")}
    assert set(got) == {(i, j) for i in range(n) for j in range(9)}
    for (i, j), x in got.items():
        want = (*t[i, j], i * (h - 1) / (n - 1), j * (w - 1) / 8)
        assert np.allclose([x["lat"], x["lon"], x["row_px"], x["col_px"]], want, atol=1e-5)
    assert {(x["i"], x["j"]) for x in rows(spark, "T2_control_points")} == {(i, j) for i in range(0, n, 10) for j in range(9)}


def test_geolocation_of_every_pixel(spark):
    t, (h, w) = ties(), lines().shape
    n = len(t)
    fa, fr = np.arange(h) * (n - 1) / (h - 1), np.arange(w) * 8 / (w - 1)
    across = np.stack([[np.interp(fr, np.arange(9), line[:, k]) for line in t] for k in (0, 1)], -1)
    want = np.stack([[np.interp(fa, np.arange(n), across[:, k, x]) for k in range(w)] for x in (0, 1)], -1)
    got = rows(spark, "T3_geolocate")
    assert len(got) == h * w
    assert all(np.allclose((x["lat"], x["lon"]), want[x["c"], x["r"]], atol=1e-5) for x in got)
    track = {x["r"]: x["lat"] for x in rows(spark, "T4_along_track")}
    assert len(track) == h and np.allclose([track[r] for r in range(h)], np.interp(fa, np.arange(n), t[:, 4, 0]), atol=1e-5)
    assert sum(x["n"] for x in rows(spark, "T7_forward_grid")) == h * w


def bilinear(v, fr, fc):
    i, j = int(fr), int(fc)
    y, x = min(i + 1, v.shape[0] - 1), min(j + 1, v.shape[1] - 1)
    a, b = fr - i, fc - j
    return v[i, j] * (1 - a) * (1 - b) + v[i, x] * (1 - a) * b + v[y, j] * a * (1 - b) + v[y, x] * a * b


def test_separable_warp_covers_the_grid(spark):
    v = lines()
    h, w = v.shape
    ys, xs = np.arange(h) * 10 + v.mean(1), np.arange(w) * 10 + v.mean(0)
    inside = lambda n, m: [i for i in range(n * 2) if m[0] <= i * 7 + 5 < m[-1]]
    want = {(i, j): bilinear(v, np.interp(i * 7 + 5, ys, np.arange(h)), np.interp(j * 7 + 5, xs, np.arange(w))) for i in inside(h, ys) for j in inside(w, xs)}
    got = {(x["r"], x["c"]): x["v"] for x in rows(spark, "T8_separable_warp")}
    assert {k for k, x in got.items() if x is not None} == set(want)
    assert all(abs(got[k] - x) < 2e-6 for k, x in want.items())


def test_coarse_grid_grows_with_the_table(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' UNION ALL SELECT vec_id + 500, * EXCLUDE (vec_id) FROM '{SF}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    for name, column, most in (("T5_resample", "dop", 41), ("T9_resample_bands", "v", 42)):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert max(x["r"] for x in got if x[column] is not None) >= 665 and max(x["c"] for x in got if x[column] is not None) == most, name


def terrain():
    v = lines()
    return v * 4 * 1000, (v < 0.1).astype(int)


def shifted(x, dr, dc):
    out = np.full(x.shape, np.nan)
    h, w = x.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = x[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def ways(table, shape):
    """Steps of each ray that stay on the grid, with their lengths in metres."""
    for ray in table:
        yield [(dr, dc, max(np.sqrt(dr * dr + dc * dc) * 20.0, 1.0)) for dr, dc in ray if abs(dr) < shape[0] and abs(dc) < shape[1]]


def dark_suns(z, azimuths):
    k, n = np.arange(1, 2501), np.zeros(z.shape, int)
    rays = [list(zip(np.rint(-np.cos(np.radians(a)) * k).astype(int), np.rint(np.sin(np.radians(a)) * k).astype(int))) for a in azimuths]
    for ray in ways(rays, z.shape):
        hidden = np.zeros(z.shape, bool)
        for dr, dc, dist in ray:
            hidden |= (shifted(z, dr, dc) - z) / dist >= np.tan(np.radians(80.0))
        n += hidden
    return n


def blind(z, psr, target, rays, radius):
    """Shadowed pixels that see no target."""
    sees = np.zeros(z.shape, bool)
    for ray in ways(rays, z.shape):
        top = np.full(z.shape, -1e18)
        for dr, dc, dist in ray:
            z1 = shifted(z, dr, dc)
            tan = (z1 - z) / dist if radius is None else (radius + z) * (radius + z1 - np.sqrt(dist * dist + (radius + z) ** 2)) / (dist * (radius + z1))
            sees |= (shifted(target, dr, dc) == 1) & (tan >= top)
            top = np.fmax(top, tan)
    return {(int(r), int(k)) for r, k in zip(*np.where((psr == 1) & ~sees))}


def test_suns_over_whole_rays(spark):
    z, _ = terrain()
    one = dark_suns(z, [137.0])
    assert {(x["r"], x["c"]): x["lit"] for x in rows(spark, "W13_sun_shadow")} == {k: 1 - n for k, n in np.ndenumerate(one)}
    year = dark_suns(z, [5.0 * a for a in range(72)])
    want = {k: (int(n < 72), n) for k, n in np.ndenumerate(year)}
    assert {(x["r"], x["c"]): (x["lit"], x["n_dark"]) for x in rows(spark, "W14_annual_illumination")} == want
    assert {(x["r"], x["c"]): x["lit"] for x in rows(spark, "K1_mask_union")} == {k: x for k, (x, _) in want.items()}


def test_sight_over_whole_rays(spark):
    from tests.test_rays import line

    z, psr = terrain()
    rays = [line(a, 72, 2500) for a in range(72)]
    want = blind(z, psr, 1 - psr, rays, 1_737_400.0)
    assert {(x["r"], x["c"]) for x in rows(spark, "W15_doubly_shadowed")} == want
    k = np.arange(1, 2501)
    rounded = [list(zip(np.rint(np.sin(a * 2 * np.pi / 72) * k).astype(int), np.rint(np.cos(a * 2 * np.pi / 72) * k).astype(int))) for a in range(72)]
    lit = 1 - dark_suns(z, [137.0])
    assert {(x["r"], x["c"]) for x in rows(spark, "W16_doubly_shadowed_flat")} == blind(z, psr, lit.astype(float), rounded, None)
    looks = {}
    for a, ray in enumerate(ways(rays, z.shape)):
        for s, (dr, dc, _) in enumerate(ray, 1):
            rise = np.where(psr == 1, shifted(z, dr, dc) - z, np.nan)
            if n := int((~np.isnan(rise)).sum()):
                looks[a, s] = (n, np.nansum(rise))
    got = {(x["a"], x["k"]): x for x in rows(spark, "D3_ray_join")}
    assert set(got) == set(looks) and all(got[i]["n"] == n and abs(got[i]["rise"] - x) < 0.01 for i, (n, x) in looks.items())
    for name in ("W17_doubly_shadowed_product", "K2_subset_check"):
        assert rows(spark, name)


def test_sight_by_small_tiles(spark):
    from rasterloom.operators import ray_pyramid, ray_tiles
    from tests.test_rays import line

    rng = np.random.default_rng(3)
    z, psr = rng.uniform(0, 60, (40, 23)), (rng.random((40, 23)) < 0.95).astype(int)
    g = spark.createDataFrame([(r, k, float(z[r, k]), int(psr[r, k])) for r, k in np.ndindex(z.shape)], "r int, c int, z double, psr int")
    table = ray_tiles.inside(ray_tiles.bresenham_table(72, 2500), *z.shape)
    got = {(x["r"], x["c"]) for x in ray_pyramid.doubly_shadowed(g, table, tile=7, block=3).collect()}
    assert got == blind(z, psr, 1 - psr, [line(a, 72, 2500) for a in range(72)], 1_737_400.0)
