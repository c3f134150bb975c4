"""W: neighbourhoods, terrain and rays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.config import SETTINGS
from rasterloom.functions import polarimetry as pol
from rasterloom.operators import eigen, focal, peaks, ray_pyramid, ray_tiles
from rasterloom.operators import rays as ray_ops
from rasterloom.operators.components import regions, without_small
from rasterloom.operators.eigen import T3
from rasterloom.operators.resample import tie_group
from rasterloom.plans.base import q6, query, r6, relation, sql
from rasterloom.plans.projections import coherency, covariance, stokes
from rasterloom.plans.scans import shape
from rasterloom.sources import derived
from rasterloom.sources.shared import written

c = F.col


def rounded(df, names, digits=6):
    return df.select("r", "c", *[r6(n, digits).alias(n) for n in names])


def _mirror(x: str, n: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"


def _look(source: str, columns: list[str], rows: int, cols: int) -> str:
    """Mean over a window with mirrored edges, by a join per neighbour."""
    a, b = rows // 2, cols // 2
    means = ", ".join(f"avg(s.{x}) AS {x}" for x in columns)
    return f"""SELECT o.r, o.c, {means} FROM (SELECT r, c, i, j, {_mirror('r + i', 'h')} AS mr, {_mirror('c + j', 'w')} AS mc
FROM grid, size, range({-a}, {rows - a}) x(i), range({-b}, {cols - b}) y(j)) o JOIN {source} s ON s.r = o.mr AND s.c = o.mc GROUP BY o.r, o.c"""


@query("W1_multilook", sql("grid size powers", f"WITH m AS ({_look('powers', ['sc', 'oc'], 19, 3)}) SELECT r, c, {q6('sc')} AS sc, {q6('oc')} AS oc FROM m"))
def w1(spark, d):
    from rasterloom.plans.projections import powers

    ml = focal.multilook(powers(spark, d).select("r", "c", "sc", "oc"), ["sc", "oc"], (19, 3), shape(spark, d))
    return rounded(ml, ["sc", "oc"])


@query("W2_multilook_valid", sql("grid size bands", f"""WITH m AS (SELECT o.r, o.c, sum(s.dop) AS s, count(s.dop) / 57.0 AS f FROM (SELECT r, c, i, j, {_mirror('r + i', 'h')} AS mr, {_mirror('c + j', 'w')} AS mc
FROM grid, size, range(-9, 10) x(i), range(-1, 2) y(j)) o JOIN bands s ON s.r = o.mr AND s.c = o.mc GROUP BY o.r, o.c)
SELECT r, c, {q6('CASE WHEN f >= 0.9 THEN s / (f * 57) END')} AS dop, {q6('f')} AS valid_fraction FROM m"""))
def w2(spark, d):
    ml = focal.multilook_valid(derived.bands(spark, d).select("r", "c", "dop"), "dop", (19, 3), shape(spark, d), 0.9)
    return rounded(ml, ["dop", "valid_fraction"])


C3 = ["c11", "c22", "c33", "c12_re", "c12_im", "span"]


@query("W3_covariance", sql("grid size covariance", f"WITH m AS ({_look('covariance', C3, 7, 3)}), s AS (SELECT r, c, c11, c22, span, c11 + c22 / 2 AS s0, c11 - c22 / 2 AS s1, sqrt(2.0::DOUBLE) * c12_re AS s2, sqrt(2.0::DOUBLE) * c12_im AS s3 FROM m)"
    f" SELECT r, c, {q6('span')} AS span, {q6('CASE WHEN s0 > 0 AND sqrt(s1 * s1 + s2 * s2 + s3 * s3) / (s0 + 1e-10) <= 1 + 1e-6 THEN least(sqrt(s1 * s1 + s2 * s2 + s3 * s3) / (s0 + 1e-10), 1) END')} AS dop FROM s"))
def w3(spark, d):
    ml = focal.multilook(covariance(spark, d), C3, (7, 3), shape(spark, d))
    s = stokes(ml).join(ml.select("r", "c", "span"), ["r", "c"])
    return s.select("r", "c", r6("span").alias("span"), r6(pol.dop_transmit(c("s0"), c("s1"), c("s2"), c("s3"))).alias("dop"))


relation("coherency", """SELECT r, c, (oc_re * oc_re + oc_im * oc_im) / 2 AS t11, ((hh_re - vv_re) ** 2 + (hh_im - vv_im) ** 2) / 2 AS t22, 2 * (xp_re * xp_re + xp_im * xp_im) AS t33,
(oc_re * (hh_re - vv_re) + oc_im * (hh_im - vv_im)) / 2 AS t12r, (oc_im * (hh_re - vv_re) - oc_re * (hh_im - vv_im)) / 2 AS t12i, oc_re * xp_re + oc_im * xp_im AS t13r, oc_im * xp_re - oc_re * xp_im AS t13i,
(hh_re - vv_re) * xp_re + (hh_im - vv_im) * xp_im AS t23r, (hh_im - vv_im) * xp_re - (hh_re - vv_re) * xp_im AS t23i FROM fields""", "fields")


@query("W4_coherency", sql("grid size coherency", f"WITH m AS ({_look('coherency', T3, 7, 3)}) SELECT r, c, {', '.join(q6(t) + f' AS {t}' for t in T3)} FROM m"))
def w4(spark, d):
    return rounded(focal.multilook(coherency(spark, d), T3, (7, 3), shape(spark, d)), T3)


_EIGEN = """a AS (SELECT *, (t11 + t22 + t33) / 3 AS q, t12r * t12r + t12i * t12i AS n12, t13r * t13r + t13i * t13i AS n13, t23r * t23r + t23i * t23i AS n23 FROM m),
b AS (SELECT *, sqrt(((t11 - q) ** 2 + (t22 - q) ** 2 + (t33 - q) ** 2 + 2 * (n12 + n13 + n23)) / 6) AS s, (t11 - q) * ((t22 - q) * (t33 - q) - n23) - (t22 - q) * n13 - (t33 - q) * n12
+ 2 * ((t12r * t23r - t12i * t23i) * t13r + (t12r * t23i + t12i * t23r) * t13i) AS det FROM a),
f AS (SELECT *, CASE WHEN s > 0 THEN acos(least(greatest(det / (2 * s * s * s), -1), 1)) / 3 ELSE 0 END AS phi FROM b),
l AS (SELECT *, q + 2 * s * cos(phi) AS l1, q + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM f), k AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM l),
v AS (SELECT *, CASE WHEN l1 - l2 > 1e-6 * s THEN ((l1 - t22) * (l1 - t33) - n23) / ((l1 - l2) * (l1 - l3)) END AS x1, CASE WHEN l2 - l3 > 1e-6 * s THEN ((l3 - t22) * (l3 - t33) - n23) / ((l3 - l1) * (l3 - l2)) END AS x3 FROM k),
x AS (SELECT *, least(greatest(l1 / greatest(3 * q, 1e-10), 1e-12), 1) AS p1, least(greatest(l2 / greatest(3 * q, 1e-10), 1e-12), 1) AS p2, least(greatest(l3 / greatest(3 * q, 1e-10), 1e-12), 1) AS p3,
coalesce(x1, (1 - x3) / 2, 1 / 3.0::DOUBLE) AS w1, coalesce(x3, (1 - x1) / 2, 1 / 3.0::DOUBLE) AS w3 FROM v)"""
_ANGLE = lambda w: f"degrees(acos(least(sqrt(greatest({w}, 0)), 1)))"


@query("B20_cloude_pottier", sql("grid size coherency", f"""WITH m AS ({_look('coherency', T3, 7, 3)}), {_EIGEN}
SELECT r, c, {q6('-(p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) / ln(3)')} AS entropy, {q6('CASE WHEN p2 + p3 > 1e-10 THEN (p2 - p3) / (p2 + p3) ELSE 0 END')} AS anisotropy,
{q6(f"p1 * {_ANGLE('w1')} + p2 * {_ANGLE('1 - w1 - w3')} + p3 * {_ANGLE('w3')}")} AS alpha FROM x"""))
def b20(spark, d):
    ml = focal.multilook(coherency(spark, d), T3, (7, 3), shape(spark, d))
    return rounded(eigen.decomposition(ml), ["entropy", "anisotropy", "alpha"])


def _gradient(source: str, dy: str = "20", dx: str = "20") -> str:
    return f"""SELECT o.r, o.c, o.z, CASE WHEN u.z IS NULL THEN (n.z - o.z) / {dy} WHEN n.z IS NULL THEN (o.z - u.z) / {dy} ELSE (n.z - u.z) / (2 * {dy}) END AS gy,
CASE WHEN l.z IS NULL THEN (e.z - o.z) / {dx} WHEN e.z IS NULL THEN (o.z - l.z) / {dx} ELSE (e.z - l.z) / (2 * {dx}) END AS gx FROM {source} o
LEFT JOIN {source} u ON u.r = o.r - 1 AND u.c = o.c LEFT JOIN {source} n ON n.r = o.r + 1 AND n.c = o.c
LEFT JOIN {source} l ON l.r = o.r AND l.c = o.c - 1 LEFT JOIN {source} e ON e.r = o.r AND e.c = o.c + 1"""


relation("gentle", "SELECT r, c, z / 100 AS z FROM dem", "dem")
relation("grad", _gradient("gentle"), "gentle")


def grad(spark, d, dy=20.0, dx=20.0):
    return focal.gradient(derived.dem(spark, d).withColumn("z", c("z") / 100), "z", dy, dx)


@query("W5_slope", sql("grad", f"SELECT r, c, {q6('degrees(atan(sqrt(gx * gx + gy * gy)))')} AS slope FROM grad"))
def w5(spark, d):
    return grad(spark, d).select("r", "c", r6(focal.slope_deg()).alias("slope"))


_LAT = -85.0
_DY = math.pi / 180 * 1_737_400.0 * 0.0005
_DX = _DY * abs(math.cos(math.radians(_LAT)))


@query("W6_slope_geographic", sql("gentle", f"WITH g AS ({_gradient('gentle', repr(_DY) + '::DOUBLE', repr(_DX) + '::DOUBLE')}) SELECT r, c, {q6('degrees(atan(sqrt(gx * gx + gy * gy)))')} AS slope FROM g"))
def w6(spark, d):
    dy, dx = focal.geographic_steps(_LAT, 0.0005, 0.0005)
    return grad(spark, d, dy, dx).select("r", "c", r6(focal.slope_deg()).alias("slope"))


@query("W7_aspect", sql("grad", f"SELECT r, c, {q6('((degrees(atan2(-gx, gy)) + 360) % 360)', 5)} AS aspect FROM grad"))
def w7(spark, d):
    return grad(spark, d).select("r", "c", r6(focal.aspect_deg(), 5).alias("aspect"))


_UNIT = "least(greatest(sin(radians(1.54::DOUBLE)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(1.54::DOUBLE)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(0 - atan2(-gx, gy)), 0), 1)"
_BYTE = "least(greatest(255 * (cos(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-gy, gx))), 0), 255)"


@query("W8_hillshade_unit", sql("grad", f"SELECT r, c, {q6(_UNIT)} AS shade FROM grad"))
def w8(spark, d):
    return grad(spark, d).select("r", "c", r6(focal.hillshade_unit()).alias("shade"))


@query("W9_hillshade_byte", sql("grad", f"SELECT r, c, {q6(_BYTE, 5)} AS shade FROM grad"))
def w9(spark, d):
    return grad(spark, d).select("r", "c", r6(focal.hillshade_byte(), 5).alias("shade"))


relation("pits", "SELECT arg_min(r, (z, r)) AS r, c, min(z) AS z FROM dem GROUP BY c", "dem")
_PROFILE = "SELECT o.r, o.c, a, k, t.r AS tr, t.c AS tc, {z0} AS z0, {z1} AS z1, {dist} AS dist FROM (SELECT r, c, z, a, k, dist, r + dr AS tr, c + dc AS tc FROM pits CROSS JOIN {rays}) o JOIN dem t ON t.r = o.tr AND t.c = o.tc"


def _profiles(rays: str, needs: str) -> str:
    return sql(f"dem pits {needs}", _PROFILE.format(rays=rays, z0=q6("o.z"), z1=q6("t.z"), dist=q6("dist")))


def profiles(spark, d, rays):
    """Heights along every ray from the lowest pixel of each column, as far as the grid goes."""
    h, w = shape(spark, d)
    z = derived.dem(spark, d)
    pits = z.groupBy("c").agg(F.min_by("r", F.struct("z", "r")).alias("r"), F.min("z").alias("z"))
    seen = ray_ops.targets(pits, rays.filter((F.abs("dr") < h) & (F.abs("dc") < w)), z)
    return seen.select("r", "c", "a", "k", "tr", "tc", r6("z0").alias("z0"), r6("z1").alias("z1"), r6("dist").alias("dist"))


@query("W10_bresenham_rays", _profiles("rays", "rays"))
def w10(spark, d):
    return profiles(spark, d, ray_ops.bresenham_rays(spark, SETTINGS.n_angles, SETTINGS.max_distance))


_TURN = f"a * (2 * 3.141592653589793::DOUBLE) / {SETTINGS.n_angles}"
relation("roundrays", f"""SELECT a, k, dr, dc, greatest(sqrt(dr * dr + dc * dc) * 20, 1)::DOUBLE AS dist FROM (SELECT a::INT AS a, k::INT AS k, round_even(sin({_TURN}) * k, 0)::INT AS dr, round_even(cos({_TURN}) * k, 0)::INT AS dc
FROM range({SETTINGS.n_angles}) x(a), range(1, {SETTINGS.max_distance + 1}) y(k)), size WHERE abs(dr) < h AND abs(dc) < w""", "size")


@query("W11_rounded_rays", _profiles("roundrays", "roundrays"))
def w11(spark, d):
    return profiles(spark, d, ray_ops.rounded_rays(spark, SETTINGS.n_angles, SETTINGS.max_distance))


def _sun(azimuths: list[float], steps: int) -> str:
    rows = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(azimuths))
    return f"""SELECT *, greatest(sqrt(dr * dr + dc * dc) * 20, 1)::DOUBLE AS dist FROM (SELECT a, k::INT AS k, round_even(-cos(radians(az)) * k, 0)::INT AS dr, round_even(sin(radians(az)) * k, 0)::INT AS dc
FROM (VALUES {rows}) x(a, az), range(1, {steps + 1}) y(k))"""


relation("sun1", f"SELECT s.* FROM ({_sun([137.0], SETTINGS.max_distance)}) s, size WHERE abs(dr) < h AND abs(dc) < w", "size")


@query("W12_sun_ray", _profiles("sun1", "sun1"))
def w12(spark, d):
    return profiles(spark, d, ray_ops.sun_rays(spark, [137.0], SETTINGS.max_distance))


def _lit(azimuths: list[float]) -> str:
    """Suns that are hidden. Nothing hides a sun from farther than the relief over the sun's slope."""
    tan, n = repr(math.tan(math.radians(80.0))), len(azimuths)
    return f"""SELECT o.r, o.c, coalesce(k, 0)::INT AS n_dark, CASE WHEN coalesce(k, 0) < {n} THEN 1 ELSE 0 END AS lit FROM dem o LEFT JOIN (
SELECT r, c, count(*) AS k FROM (SELECT DISTINCT o.r, o.c, a FROM (SELECT r, c, z, a, dist, r + dr AS tr, c + dc AS tc FROM dem CROSS JOIN (
SELECT s.* FROM ({_sun(azimuths, SETTINGS.max_distance)}) s, size, (SELECT max(z) - min(z) AS relief FROM dem) WHERE abs(dr) < h AND abs(dc) < w AND dist <= relief / {tan}::DOUBLE + 20)) o
JOIN dem t ON t.r = tr AND t.c = tc WHERE (t.z - o.z) / dist >= {tan}::DOUBLE) GROUP BY r, c) x ON x.r = o.r AND x.c = o.c"""


SUNS = [360.0 * a / SETTINGS.n_angles for a in range(SETTINGS.n_angles)]
relation("lit1", _lit([137.0]), "dem size")
relation("year", _lit(SUNS), "dem size")
TILE = 512


def sunlit(spark, d, azimuths):
    return ray_pyramid.illumination(derived.dem(spark, d), azimuths, 80.0, SETTINGS.max_distance, TILE, shape=shape(spark, d))


@query("W13_sun_shadow", sql("lit1", "SELECT r, c, lit FROM lit1"))
def w13(spark, d):
    return sunlit(spark, d, [137.0]).select("r", "c", "lit")


@query("W14_annual_illumination", sql("year", "SELECT r, c, lit, n_dark FROM year"))
def w14(spark, d):
    return sunlit(spark, d, SUNS)


def dpsr(spark, d):
    table = ray_tiles.bresenham_table(SETTINGS.n_angles, SETTINGS.max_distance)
    return ray_pyramid.doubly_shadowed(derived.shadow(spark, d), table, TILE, shape=shape(spark, d))


@query("W15_doubly_shadowed", sql("dpsr", "SELECT r, c FROM dpsr"))
def w15(spark, d):
    return dpsr(spark, d)


def _flat(observers: str, rays: str) -> str:
    """Observers that see a lit pixel, over a plane."""
    return f"""SELECT DISTINCT r, c FROM (SELECT *, max(tan) OVER (PARTITION BY r, c, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
SELECT o.r, o.c, a, k, (t.z - o.z) / dist AS tan, t.lit FROM (SELECT r, c, z, a, k, dist, r + dr AS tr, c + dc AS tc FROM {observers} CROSS JOIN {rays}) o
JOIN (SELECT r, c, z, lit FROM shadow JOIN lit1 USING (r, c)) t ON t.r = tr AND t.c = tc)) WHERE lit = 1 AND tan >= coalesce(before, -1e18)"""


relation("unlit", f"SELECT * FROM dark ANTI JOIN ({_flat('dark', '(SELECT * FROM roundrays WHERE k <= 4)')}) USING (r, c)", "dark roundrays lit1")


@query("W16_doubly_shadowed_flat", sql("unlit roundrays", f"SELECT r, c FROM unlit ANTI JOIN ({_flat('unlit', 'roundrays')}) USING (r, c)"))
def w16(spark, d):
    s = derived.shadow(spark, d).join(sunlit(spark, d, [137.0]).select("r", "c", "lit"), ["r", "c"])
    table = ray_tiles.rounded_table(SETTINGS.n_angles, SETTINGS.max_distance)
    return ray_pyramid.doubly_shadowed(s, table, TILE, None, "lit", shape(spark, d))


_REGIONS = """near AS (SELECT a.r, a.c, b.r AS r2, b.c AS c2 FROM {m} a JOIN {m} b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND {way}),
reach AS (SELECT r, c, r AS r2, c AS c2 FROM {m} UNION SELECT reach.r, reach.c, near.r2, near.c2 FROM reach JOIN near ON near.r = reach.r2 AND near.c = reach.c2),
label AS (SELECT r, c, min(r2 * 64 + c2)::BIGINT AS label FROM reach GROUP BY r, c)"""


def _components(m: str, body: str, needs: str, way: str = "true") -> str:
    return sql(needs, "WITH " + _REGIONS.format(m=m, way=way) + body, recursive=True)


@query("W17_doubly_shadowed_product", _components("dpsr", ", big AS (SELECT r, c FROM label WHERE label IN (SELECT label FROM label GROUP BY label HAVING count(*) >= 5)) SELECT g.r, g.c, CASE WHEN big.r IS NULL THEN 0 ELSE 1 END AS dpsr FROM grid g LEFT JOIN big ON big.r = g.r AND big.c = g.c", "dpsr grid"))
def w17(spark, d):
    kept = without_small(regions(dpsr(spark, d), derived.WIDTH), 5)
    return ray_ops.scattered(derived.grid(spark, d), kept, "dpsr")


@query("W18_density", sql("grid size", f"""WITH p AS (SELECT r, avg((v > 0.12)::INT) AS x FROM grid GROUP BY r)
SELECT o.r, {q6('avg(p.x)')} AS dens FROM (SELECT r, {_mirror('r + i', 'h')} AS mr FROM (SELECT DISTINCT r FROM grid), (SELECT DISTINCT h FROM size), range(-75, 75) x(i)) o JOIN p ON p.r = o.mr GROUP BY o.r"""))
def w18(spark, d):
    return peaks.density(derived.grid(spark, d), c("v") > 0.12, 150, shape(spark, d)[0]).select("r", r6("dens").alias("dens"))


@query("W19_peaks", sql("grid size", f"""WITH p AS (SELECT r, avg((v > 0.12)::INT) AS x FROM grid GROUP BY r),
s AS (SELECT o.r, avg(p.x) AS dens FROM (SELECT r, {_mirror('r + i', 'h')} AS mr FROM (SELECT DISTINCT r FROM grid), size, range(-5, 5) x(i)) o JOIN p ON p.r = o.mr GROUP BY o.r),
t AS (SELECT *, sum(fresh) OVER (ORDER BY r) AS g FROM (SELECT *, CASE WHEN lag(dens) OVER (ORDER BY r) = dens THEN 0 ELSE 1 END AS fresh FROM s)),
u AS (SELECT g, (min(r) + max(r)) // 2 AS r, any_value(dens) AS dens FROM t GROUP BY g),
m AS (SELECT r, dens, row_number() OVER (ORDER BY dens DESC, r DESC) AS k FROM (SELECT *, lag(dens) OVER (ORDER BY g) AS b, lead(dens) OVER (ORDER BY g) AS e FROM u) WHERE b < dens AND e < dens AND dens >= 0.003),
choice AS (SELECT 0::BIGINT AS k, []::INT[] AS kept UNION ALL SELECT m.k, CASE WHEN len(list_filter(kept, lambda y: abs(y - m.r) < 20)) = 0 THEN list_append(kept, m.r::INT) ELSE kept END FROM choice JOIN m ON m.k = choice.k + 1)
SELECT m.r::INT AS r, {q6('dens')} AS dens FROM m WHERE list_contains((SELECT arg_max(kept, k) FROM choice), m.r::INT) ORDER BY dens DESC, m.r LIMIT 9""", recursive=True))
def w19(spark, d):
    """The choice of the nine tallest, 20 lines apart; the SQL states the case that there are peaks, which the tables have,
    and tests/test_grids.py holds the evenly spaced lines of the other."""
    h = shape(spark, d)[0]
    profile = written(peaks.density(derived.grid(spark, d), c("v") > 0.12, 10, h), "density")
    return peaks.centres(profile, 0.003, 20, 9, h, 10).select("r", r6("dens").alias("dens"))


@query("W20_tie_groups", sql("ties", "SELECT min(n) + 1 AS n_rng FROM (SELECT n, slant, lead(slant) OVER (ORDER BY n) AS nx FROM ties) WHERE nx - slant < -100"))
def w20(spark, d):
    return tie_group(derived.ties(spark, d), -100.0).select("n_rng")


relation("mask", "SELECT r, c FROM grid WHERE v > 0.12", "grid")


def mask(spark, d):
    return derived.grid(spark, d).filter("v > 0.12").select("r", "c")


@query("F15_component_sizes", _components("mask", " SELECT label, count(*) AS size FROM label GROUP BY label", "mask"))
def f15(spark, d):
    return regions(mask(spark, d), derived.WIDTH).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


_EDGES = [1, 2, 3, 4, 5, 10, 25, 50, 100, 500, 1000]


@query("F16_component_distribution", _components("mask", f""", s AS (SELECT count(*) AS n FROM label GROUP BY label)
SELECT (SELECT max(e) FROM (SELECT unnest({_EDGES}) AS e) WHERE e <= n)::INT AS from_size, count(*) AS regions, sum(n)::BIGINT AS pixels FROM s GROUP BY 1""", "mask"))
def f16(spark, d):
    sizes = regions(mask(spark, d), derived.WIDTH).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    step = F.array_max(F.filter(F.array(*map(F.lit, _EDGES)), lambda e: e <= c("n")))
    return sizes.groupBy(step.alias("from_size")).agg(F.count(F.lit(1)).alias("regions"), F.sum("n").alias("pixels"))


@query("I1_regions", _components("mask", ", k AS (SELECT label, count(*) AS size FROM label GROUP BY label) SELECT r, c, label, size FROM label JOIN k USING (label) WHERE size >= 5", "mask"))
def i1(spark, d):
    return without_small(regions(mask(spark, d), derived.WIDTH), 5).select("r", "c", "label", "size")


@query("I2_regions_four", _components("mask", ", k AS (SELECT label, count(*) AS size FROM label GROUP BY label) SELECT count(*) AS n, max(size) AS largest, quantile_cont(size, 0.5)::DOUBLE AS median FROM k", "mask", "abs(a.r - b.r) + abs(a.c - b.c) <= 1"))
def i2(spark, d):
    sizes = regions(mask(spark, d), derived.WIDTH, 4).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"), F.percentile("size", F.lit(0.5)).alias("median"))
