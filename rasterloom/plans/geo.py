"""T, I, J and K: geolocation, resampling, vectors, ranking and set operations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.config import SETTINGS
from rasterloom.functions import geodesy
from rasterloom.operators import control_points, nearest, paths, peaks, polygons, resample
from rasterloom.operators.quantiles import quantiles
from rasterloom.plans.base import q6, query, r6, relation, sql
from rasterloom.plans.joins import customer_sides
from rasterloom.plans.projections import _HAV
from rasterloom.plans.windows import SUNS, dpsr, grad, shape, sunlit
from rasterloom.sources import derived
from rasterloom.sources.rasters import Frame
from rasterloom.sources.shared import written

c = F.col
N_RG = 9
relation("lay", f"SELECT h, w, n // {N_RG} AS n_az FROM size, (SELECT count(*) AS n FROM events)", "size")
relation("tiegrid", f"""SELECT (n // {N_RG})::INT AS i, (n % {N_RG})::INT AS j, lat, lon, (n // {N_RG}) * (h - 1) / (n_az - 1)::DOUBLE AS row_px, (n % {N_RG}) * (w - 1) / {N_RG - 1}.0::DOUBLE AS col_px
FROM ties, lay WHERE n < n_az * {N_RG}""", "ties lay")
relation("scene", "SELECT r, c, h, w FROM size, (SELECT unnest(range(h)) AS r FROM size), (SELECT unnest(range(w)) AS c FROM size)", "size")


def n_az(spark, d) -> int:
    """Whole lines of tie points, as tie_group() counts them."""
    return derived.table(spark, d, "events").count() // N_RG


def tie_grid(spark, d):
    return resample.tie_grid(derived.ties(spark, d), N_RG, n_az(spark, d), *shape(spark, d))


def target(spark, h, w):
    return spark.range(h).select(c("id").cast("int").alias("r")).crossJoin(spark.range(w).select(c("id").cast("int").alias("c")))


@query("T1_tie_grid", sql("tiegrid", f"SELECT i, j, {', '.join(q6(x) + f' AS {x}' for x in ('lat', 'lon', 'row_px', 'col_px'))} FROM tiegrid"))
def t1(spark, d):
    return tie_grid(spark, d).select("i", "j", *[r6(x).alias(x) for x in ("lat", "lon", "row_px", "col_px")])


@query("T2_control_points", sql("tiegrid", f"SELECT i, j, {q6('lat')} AS lat, {q6('lon')} AS lon FROM tiegrid WHERE i % 10 = 0"))
def t2(spark, d):
    return resample.control_points(tie_grid(spark, d)).select("i", "j", r6("lat").alias("lat"), r6("lon").alias("lon"))


_POINTS = f"""SELECT r, c, fa, fr, least(greatest(floor(fa), 0), n_az - 2)::INT AS i, least(greatest(floor(fr), 0), {N_RG - 2})::INT AS j FROM (
SELECT r, c, n_az, r * (n_az - 1) / (lay.h - 1)::DOUBLE AS fa, c * {N_RG - 1} / (lay.w - 1)::DOUBLE AS fr FROM scene, lay)"""
_MIX = lambda v: f"a.{v} * (1 - (fa - p.i)) * (1 - (fr - p.j)) + b.{v} * (1 - (fa - p.i)) * (fr - p.j) + d.{v} * (fa - p.i) * (1 - (fr - p.j)) + e.{v} * (fa - p.i) * (fr - p.j)"
relation("located", f"""SELECT p.r, p.c, {_MIX('lat')} AS lat, {_MIX('lon')} AS lon FROM ({_POINTS}) p JOIN tiegrid a ON a.i = p.i AND a.j = p.j JOIN tiegrid b ON b.i = p.i AND b.j = p.j + 1
JOIN tiegrid d ON d.i = p.i + 1 AND d.j = p.j JOIN tiegrid e ON e.i = p.i + 1 AND e.j = p.j + 1""", "tiegrid scene")


def located(spark, d):
    (h, w), n = shape(spark, d), n_az(spark, d)
    fi, fj = c("r").cast("long") * (n - 1) / float(h - 1), c("c") * (N_RG - 1) / float(w - 1)
    return resample.interpolate(target(spark, h, w), tie_grid(spark, d), ["lat", "lon"], fi, fj, n, N_RG)


@query("T3_geolocate", sql("located", f"SELECT r::INT AS r, c::INT AS c, {q6('lat')} AS lat, {q6('lon')} AS lon FROM located"))
def t3(spark, d):
    return located(spark, d).select("r", "c", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("D6_nearest_tie_pixels", sql("located ties", f"""WITH p AS (SELECT r, c, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM located),
t AS (SELECT n, lat AS lat2, lon AS lon2, cos(radians(lat)) * cos(radians(lon)) AS u, cos(radians(lat)) * sin(radians(lon)) AS v, sin(radians(lat)) AS w FROM ties),
b AS (SELECT r, c, lat, lon, x, y, z, min((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)) AS d FROM p, t GROUP BY ALL),
m AS (SELECT r, c, n, {_HAV} AS km FROM b JOIN t ON abs(x - u) <= sqrt(d) + 1e-7 AND (x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w) <= (sqrt(d) + 1e-7) ** 2)
SELECT r::INT AS r, c::INT AS c, arg_min(n, (round(km, 6), n)) AS n, {q6('min(km)')} AS km FROM m GROUP BY r, c"""))
def d6_pixels(spark, d):
    """The nearest tie point of every pixel of the scene."""
    return nearest.nearest_on_sphere(located(spark, d), derived.ties(spark, d)).select("r", "c", "n", r6("km").alias("km"))


@query("T4_along_track", sql("tiegrid lay", f"""WITH p AS (SELECT r, fa, least(floor(fa), n_az - 2)::INT AS i FROM (SELECT r, n_az, r * (n_az - 1) / (h - 1)::DOUBLE AS fa FROM (SELECT unnest(range(h)) AS r, h, n_az FROM lay)))
SELECT p.r::INT AS r, {q6('a.lat + (fa - p.i) * (b.lat - a.lat)')} AS lat FROM p JOIN tiegrid a ON a.i = p.i AND a.j = 4 JOIN tiegrid b ON b.i = p.i + 1 AND b.j = 4"""))
def t4(spark, d):
    mid = tie_grid(spark, d).filter(c("j") == N_RG // 2).select("i", "lat")
    step = mid.join(mid.select((c("i") - 1).alias("i"), c("lat").alias("next")), "i")
    (h, _), n = shape(spark, d), n_az(spark, d)
    fa = c("r").cast("long") * (n - 1) / float(h - 1)
    lines = spark.range(h).select(c("id").cast("int").alias("r")).withColumn("fa", fa).withColumn("i", F.least(F.floor("fa"), F.lit(n - 2)).cast("int"))
    return lines.join(step, "i").select("r", r6(c("lat") + (c("fa") - c("i")) * (c("next") - c("lat"))).alias("lat"))


_STEP = 1.5
_DST = f"""SELECT r, c, (r + 0.5) * {_STEP}::DOUBLE - 0.5 AS fr, (c + 0.5) * {_STEP}::DOUBLE - 0.5 AS fc
FROM (SELECT unnest(range(ceil((h + 1) / {_STEP}::DOUBLE)::BIGINT)) AS r FROM size), (SELECT unnest(range(ceil((w + 1) / {_STEP}::DOUBLE)::BIGINT)) AS c FROM size)"""
_RESAMPLED = f"""WITH p AS MATERIALIZED ({_DST}), k AS (SELECT p.r, p.c, CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS wt,
floor(fr)::INT + i AS sr, floor(fc)::INT + j AS sc, fr BETWEEN 0 AND h - 1 AND fc BETWEEN 0 AND w - 1 AS inside FROM p, size, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
g AS (SELECT k.r, k.c, sum(CASE WHEN inside THEN wt * coalesce(dop, 0) END) AS s, sum(CASE WHEN dop IS NULL THEN wt ELSE 0 END) AS bad FROM k LEFT JOIN bands b ON b.r = sr AND b.c = sc WHERE wt > 0 GROUP BY k.r, k.c)"""


def coarse(spark, d):
    """The coarser grid over the whole of the source, ending behind its last pixel."""
    h, w = shape(spark, d)
    return target(spark, *(math.ceil((n + 1) / _STEP) if h else 0 for n in (h, w)))


@query("T5_resample", sql("grid size bands", _RESAMPLED + f" SELECT r::INT AS r, c::INT AS c, {q6('CASE WHEN bad <= 0.5 THEN s END')} AS dop FROM g"))
def t5(spark, d):
    h, w = shape(spark, d)
    out = resample.sampled(coarse(spark, d), derived.bands(spark, d).select("r", "c", "dop"), "dop", (c("r") + 0.5) * _STEP - 0.5, (c("c") + 0.5) * _STEP - 0.5, h, w)
    return out.select("r", "c", r6("dop").alias("dop"))


_R = "1737400.0::DOUBLE"
#: A grid that names no coordinate system.
LATLON = Frame("", -180.0, -90.0, 0.02)


def plane_half(spark, d) -> int:
    """Half the side, in pixels, of the square on the plane that holds the whole source."""
    h, _ = shape(spark, d)
    return math.ceil(2 * SETTINGS.moon_radius_m * math.tan(math.radians(h * 0.02 / 2)) / 5000)


def plane_square(spark, n: int):
    return target(spark, 2 * n, 2 * n).withColumns({"x": -5000.0 * n + c("c") * 5000.0 + 100, "y": 5000.0 * n - c("r") * 5000.0 + 100})


@query("T6_align", sql("grid size", f"""WITH n AS (SELECT ceil(2 * {_R} * tan(radians(h * 0.02 / 2)) / 5000)::BIGINT AS n FROM size), m AS (SELECT n, unnest(range(2 * n)) AS k FROM n),
p AS (SELECT a.k AS r, b.k AS c, -5000.0::DOUBLE * a.n + b.k * 5000.0::DOUBLE + 100 AS x, 5000.0::DOUBLE * a.n - a.k * 5000.0::DOUBLE + 100 AS y FROM m a, m b),
g AS (SELECT r, c, floor((degrees(2 * atan(sqrt(x * x + y * y) / (2 * {_R}))) - 90 + 90) / 0.02)::INT AS sr, floor((degrees(atan2(x, y)) + 180) / 5.625)::INT AS sc FROM p)
SELECT g.r::INT AS r, g.c::INT AS c, {q6('v * 1000')} AS v FROM g LEFT JOIN grid s ON s.r = g.sr AND s.c = g.sc"""))
def t6(spark, d):
    """Scaled values at the nearest source pixel, over the square on the plane that holds the whole source."""
    n = plane_half(spark, d)
    return resample.aligned(plane_square(spark, n), derived.grid(spark, d), "v", LATLON, shape(spark, d), 1000.0, True, 5.625).select("r", "c", r6("v").alias("v"))


@query("T6_align_bilinear", sql("grid size bands", f"""WITH n AS (SELECT ceil(2 * {_R} * tan(radians(h * 0.02 / 2)) / 5000)::BIGINT AS n FROM size), m AS MATERIALIZED (SELECT n, unnest(range(2 * n)) AS k FROM n),
p AS (SELECT a.k AS r, b.k AS c, -5000.0::DOUBLE * a.n + b.k * 5000.0::DOUBLE + 100 AS x, 5000.0::DOUBLE * a.n - a.k * 5000.0::DOUBLE + 100 AS y FROM m a, m b),
g AS MATERIALIZED (SELECT r, c, (degrees(2 * atan(sqrt(x * x + y * y) / (2 * {_R}))) - 90 + 90) / 0.02 - 0.5 AS fr, (degrees(atan2(x, y)) + 180) / 5.625 - 0.5 AS fc FROM p),
k AS (SELECT r, c, floor(fr)::INT + i AS sr, floor(fc)::INT + j AS sc, CASE WHEN fr BETWEEN -0.5 AND h - 0.5 AND fc BETWEEN -0.5 AND w - 0.5
THEN (CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) END AS wt
FROM g, size, (VALUES (0), (1)) z(i), (VALUES (0), (1)) o(j)),
v AS (SELECT k.r, k.c, sum(wt * dop * 1000) FILTER (wt > 0) / sum(wt) FILTER (wt > 0 AND dop IS NOT NULL) AS v FROM k LEFT JOIN bands s ON s.r = sr AND s.c = sc GROUP BY k.r, k.c)
SELECT r::INT AS r, c::INT AS c, {q6('v')} AS v FROM v"""))
def t6_bilinear(spark, d):
    """The same, bilinear, of a band with gaps."""
    n = plane_half(spark, d)
    out = resample.aligned(plane_square(spark, n), derived.bands(spark, d), "dop", LATLON, shape(spark, d), 1000.0, False, 5.625)
    return out.select("r", "c", r6("dop").alias("v"))


_INV = "SELECT {k}, {m}, lead({m}) OVER (ORDER BY {k}) AS m2 FROM (SELECT {k}, avg({x}) AS {m} FROM s GROUP BY {k})"


_CELL = f"""SELECT l.r, l.c, v, 2 * {_R} * tan(pi() / 4 + radians(lat) / 2) * sin(radians(lon)) AS x, 2 * {_R} * tan(pi() / 4 + radians(lat) / 2) * cos(radians(lon)) AS y
FROM located l JOIN grid g ON g.r = l.r AND g.c = l.c"""


def on_plane(spark, d):
    x, y = geodesy.to_plane(c("lat"), c("lon"))
    return located(spark, d).join(derived.grid(spark, d), ["r", "c"]).select("r", "c", "v", x.alias("x"), y.alias("y"))


def forward(spark, d):
    """Count and mean of the pixels that fall into each cell of the plane."""
    row, col = geodesy.cell_floor(c("x"), c("y"), -300000.0, 300000.0, 20000.0, -20000.0)
    return on_plane(spark, d).groupBy(row.alias("tr"), col.alias("tc")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def inverse_grid(spark, d):
    """The cells of the target read back from the source by the separable inverse mapping."""
    cells = target(spark, SIDE, SIDE).withColumns({"x": -300000.0 + (c("c") + 0.5) * 20000.0, "y": 300000.0 - (c("r") + 0.5) * 20000.0})
    out = resample.separable_warp(on_plane(spark, d), cells, "v", *shape(spark, d))
    return out.filter("v is not null").select(c("r").alias("tr"), c("c").alias("tc"), c("v").alias("mean"))


@query("T7_forward_grid", sql("located grid", f"""WITH p AS ({_CELL}), k AS (SELECT *, floor((x + 300000) / 20000)::INT AS tc, floor((300000 - y) / 20000)::INT AS tr FROM p)
SELECT tr, tc, count(*) AS n, {q6('avg(v)')} AS mean FROM k GROUP BY tr, tc"""))
def t7(spark, d):
    """Forward gridding by tie points: a stand-in for a black-box warp, not equal to it."""
    return forward(spark, d).select("tr", "tc", "n", r6("mean").alias("mean"))


SIDE = 30  # cells of the target on the plane


@query("T7_georeferenced", sql("located grid", f"""WITH p AS ({_CELL}), k AS (SELECT *, floor((x + 300000) / 20000)::INT AS tc, floor((300000 - y) / 20000)::INT AS tr FROM p)
SELECT tr, tc, {q6('avg(v)')} AS mean FROM k WHERE tr BETWEEN 0 AND {SIDE - 1} AND tc BETWEEN 0 AND {SIDE - 1} GROUP BY tr, tc"""))
def t7_georeferenced(spark, d):
    """The forward grid on its target, or the inverse mapping of T8 where it fills too little of it. The SQL states
    the first case, which is that of the test tables; tests/test_products.py holds the second."""
    on = c("tr").between(0, SIDE - 1) & c("tc").between(0, SIDE - 1)
    first = written(forward(spark, d).filter(on).select("tr", "tc", "mean"), "forward")
    return resample.filled_or(first, SIDE * SIDE, lambda: inverse_grid(spark, d)).select("tr", "tc", r6("mean").alias("mean"))


#: Control points: every tenth line and seventh column of a scene that is bent and noisy.
relation("controls", "SELECT r, c, c * 10 + v + r * c * 0.001::DOUBLE AS x, r * 10 + v - c * c * 0.05::DOUBLE AS y FROM grid WHERE r % 10 = 0 AND c % 7 = 0", "grid")
DEGREE = 2
_TERMS = control_points.powers(DEGREE)
_EXTENT = "(SELECT (min(x) + max(x)) / 2 AS mx, (max(x) - min(x)) / 2 AS sx, (min(y) + max(y)) / 2 AS my, (max(y) - min(y)) / 2 AS sy FROM controls)"
relation("scaled", f"SELECT *, (x - mx) / sx AS u, (y - my) / sy AS w FROM controls, {_EXTENT}", "controls")
_TERM = lambda i, j: " * ".join(["1.0::DOUBLE"] + ["u"] * i + ["w"] * j)
_NORMAL = ", ".join("[" + ", ".join([f"sum({_TERM(a + i, b + j)})" for i, j in _TERMS] + [f"sum({_TERM(a, b)} * {k})" for k in "rc"]) + "]" for a, b in _TERMS)
#: The normal equations with both right sides, reduced column by column.
relation("normal0", f"SELECT [{_NORMAL}] AS m FROM scaled", "scaled")
for _k in range(1, len(_TERMS) + 1):
    relation(f"normal{_k}", f"""SELECT list_transform(m, lambda row, i: CASE WHEN i = {_k} THEN list_transform(row, lambda z: z / m[{_k}][{_k}])
ELSE list_transform(row, lambda z, j: z - row[{_k}] / m[{_k}][{_k}] * m[{_k}][j]) END) AS m FROM normal{_k - 1}""", f"normal{_k - 1}")
_FITTED = f"normal{len(_TERMS)}"
_POLYNOMIAL = lambda side: " + ".join(f"m[{n}][{len(_TERMS) + side}] * {_TERM(i, j)}" for n, (i, j) in enumerate(_TERMS, 1))


def controls(spark, d):
    g = derived.grid(spark, d).filter("r % 10 = 0 and c % 7 = 0")
    return g.select("r", "c", (c("c") * 10 + c("v") + c("r") * c("c") * 0.001).alias("x"), (c("r") * 10 + c("v") - c("c") * c("c") * 0.05).alias("y"))


@query("T7_control_residuals", sql(f"scaled {_FITTED}", f"""WITH p AS (SELECT r, c, {_POLYNOMIAL(1)} - r AS dr, {_POLYNOMIAL(2)} - c AS dc FROM scaled, {_FITTED})
SELECT r, c, {q6('dr')} AS dr, {q6('dc')} AS dc, {q6('sqrt(dr * dr + dc * dc)')} AS miss FROM p"""))
def t7_residuals(spark, d):
    """By how many pixels the fitted polynomials miss each control point."""
    points = controls(spark, d)
    out = control_points.residuals(points, control_points.fitted(points, DEGREE))
    return out.select("r", "c", *[r6(x).alias(x) for x in ("dr", "dc", "miss")])


def scene_points(spark, d):
    """Targets 7 apart over places whose lines and columns lie 10 apart."""
    h, w = shape(spark, d)
    return target(spark, math.ceil(h * 10 / 7), math.ceil(w * 10 / 7)).withColumns({"y": c("r") * 7 + 5.0, "x": c("c") * 7 + 5.0})


@query("T7_control_point_warp", sql(f"grid size controls {_FITTED}", f"""WITH t AS (SELECT i, j, (j * 7 + 5 - mx) / sx AS u, (i * 7 + 5 - my) / sy AS w FROM (SELECT unnest(range(ceil(h * 10 / 7.0::DOUBLE)::BIGINT)) AS i FROM size), (SELECT unnest(range(ceil(w * 10 / 7.0::DOUBLE)::BIGINT)) AS j FROM size), {_EXTENT}),
p AS (SELECT i, j, {_POLYNOMIAL(1)} AS fr, {_POLYNOMIAL(2)} AS fc FROM t, {_FITTED}),
k AS (SELECT i, j, CASE q WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE o WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS wt, floor(fr)::INT + q AS sr, floor(fc)::INT + o AS sc
FROM p, size, (VALUES (0), (1)) a(q), (VALUES (0), (1)) b(o) WHERE fr BETWEEN 0 AND h - 1 AND fc BETWEEN 0 AND size.w - 1)
SELECT k.i::INT AS r, k.j::INT AS c, {q6('sum(wt * v)')} AS v FROM k JOIN grid g ON g.r = sr AND g.c = sc WHERE wt > 0 GROUP BY k.i, k.j"""))
def t7_warp(spark, d):
    """The scene on its target by its control points, or by the inverse mapping of T8 where that fills under 0.5 % of it. The
    SQL states the first case, which is that of the test tables; tests/test_warps.py holds the second."""
    h, w = shape(spark, d)
    fit = control_points.fitted(controls(spark, d), DEGREE)
    points, g = scene_points(spark, d), derived.grid(spark, d)
    if fit is None:
        return points.select("r", "c", F.lit(None).cast("double").alias("v")).limit(0)
    first = written(control_points.warped(g, points, "v", fit, h, w).filter("v is not null"), "warp")
    cells = math.ceil(h * 10 / 7) * math.ceil(w * 10 / 7)
    return resample.filled_or(first, cells, lambda: resample.separable_warp(placed(g), points, "v", h, w).filter("v is not null")).select("r", "c", r6("v").alias("v"))


def placed(g):
    return g.select("r", "c", "v", (c("c") * 10.0 + c("v")).alias("x"), (c("r") * 10.0 + c("v")).alias("y"))


@query("T9_resample_bands", sql("grid size bands", " UNION ALL ".join(
    f"(SELECT '{b}' AS band, p.r::INT AS r, p.c::INT AS c, {q6(b)} AS v FROM ({_DST}) p LEFT JOIN bands s ON s.r = floor((p.r + 0.5) * 1.5) AND s.c = floor((p.c + 0.5) * 1.5))" for b in ("zit", "slope"))))
def t9(spark, d):
    """Several bands to one coarser grid, nearest pixel: one join for all bands."""
    names = ("zit", "slope")
    b = derived.bands(spark, d).select("r", "c", F.struct(*names).alias("v"))
    at = [F.floor((c(x) + 0.5) * _STEP).cast("int") for x in ("r", "c")]
    one = resample.nearest(coarse(spark, d), b, "v", *at)
    pairs = ", ".join(f"'{n}', v.{n}" for n in names)
    return one.selectExpr("r", "c", f"stack({len(names)}, {pairs}) as (band, v)").select("band", "r", "c", r6("v").alias("v"))


@query("T8_separable_warp", sql("grid size", f"""WITH s AS (SELECT r, c, c * 10.0::DOUBLE + v AS x, r * 10.0::DOUBLE + v AS y FROM grid), ys AS ({_INV.format(k='r', m='m', x='y')}), xs AS ({_INV.format(k='c', m='m', x='x')}),
p AS (SELECT i, j, ys.r + (i * 7 + 5.0::DOUBLE - ys.m) / (ys.m2 - ys.m) AS fr, xs.c + (j * 7 + 5.0::DOUBLE - xs.m) / (xs.m2 - xs.m) AS fc FROM (SELECT unnest(range(ceil(h * 10 / 7.0::DOUBLE)::BIGINT)) AS i FROM size) JOIN ys ON i * 7 + 5 >= ys.m AND i * 7 + 5 < ys.m2, (SELECT unnest(range(ceil(w * 10 / 7.0::DOUBLE)::BIGINT)) AS j FROM size) JOIN xs ON j * 7 + 5 >= xs.m AND j * 7 + 5 < xs.m2),
k AS (SELECT i, j, CASE q WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE u WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS wt, floor(fr) + q AS sr, floor(fc) + u AS sc FROM p, (VALUES (0), (1)) z(q), (VALUES (0), (1)) o(u))
SELECT k.i::INT AS r, k.j::INT AS c, {q6('sum(wt * v)')} AS v FROM k JOIN grid g ON g.r = sr AND g.c = sc WHERE wt > 0 GROUP BY k.i, k.j"""))
def t8(spark, d):
    h, w = shape(spark, d)
    return resample.separable_warp(placed(derived.grid(spark, d)), scene_points(spark, d), "v", h, w).select("r", "c", r6("v").alias("v"))


@query("T10_rasterise", sql("inner_pixels", "SELECT r, c, inside AS psr FROM inner_pixels"))
def t10(spark, d):
    return polygons.covered(derived.grid(spark, d), customer_sides(spark, d)).withColumnRenamed("inside", "psr")


@query("T11_patch_resize", sql("bands", f"""WITH s AS (SELECT r - 100 AS r, c, dop FROM bands WHERE r BETWEEN 100 AND 139), m AS (SELECT avg(dop) AS m FROM s),
p AS (SELECT r, c, r * 39 / 49.0::DOUBLE AS fr, c * 63 / 49.0::DOUBLE AS fc FROM range(50) a(r), range(50) b(c)),
k AS (SELECT p.r, p.c, CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END * CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS wt, floor(fr) + i AS sr, floor(fc) + j AS sc FROM p, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
g AS (SELECT k.r, k.c, sum(wt * coalesce(dop, m)) AS v, sum(CASE WHEN dop IS NULL THEN wt ELSE 0 END) AS bad FROM k JOIN s ON s.r = sr AND s.c = sc, m WHERE wt > 0 GROUP BY k.r, k.c)
SELECT r::INT AS r, c::INT AS c, {q6('CASE WHEN bad <= 0.4 THEN v END')} AS dop FROM g"""))
def t11(spark, d):
    s = derived.bands(spark, d).filter(c("r").between(100, 139)).select((c("r") - 100).alias("r"), "c", "dop")
    return resample.resized(s, "dop", (40, 64), 50).select("r", "c", r6("dop").alias("dop"))


@query("T12_decimate", sql("grid", f"SELECT (r // 8)::INT AS r, (c // 8)::INT AS c, {q6('v')} AS v FROM grid WHERE r % 8 = 0 AND c % 8 = 0"))
def t12(spark, d):
    g = derived.grid(spark, d).filter("r % 8 = 0 and c % 8 = 0")
    return g.select(F.floor(c("r") / 8).cast("int").alias("r"), F.floor(c("c") / 8).cast("int").alias("c"), r6("v").alias("v"))


@query("I3_rover_path")
def i3(spark, d):
    """The least-cost path over the slopes from the first pixel to the last; an extension, as its model is only sketched elsewhere.
    Without SQL: tests/test_paths.py holds it against recursive SQL on a fixture, and against a plain search."""
    cost = written(grad(spark, d).select("r", "c", (1 + F.abs("gx") + F.abs("gy")).alias("cost")), "slopes")
    h, w = shape(spark, d)
    return paths.least_path(cost, (0, 0), (h - 1, w - 1)).select("k", "r", "c", r6("dist").alias("dist"))


@query("I4_landing_rank", sql("scored bands", f"SELECT r, c, {q6('0.7::DOUBLE * score - 0.3::DOUBLE * slope / 40')} AS merit FROM scored JOIN bands USING (r, c) WHERE slope < 10 ORDER BY round(0.7::DOUBLE * score - 0.3::DOUBLE * slope / 40, 6) DESC, r, c LIMIT 25"))
def i4(spark, d):
    from rasterloom.functions.scaling import confidence

    s = confidence(derived.bands(spark, d).withColumn("raw", c("slope"))).filter(c("raw") < 10)
    s = s.select("r", "c", r6(0.7 * c("score") - 0.3 * c("raw") / 40).alias("merit"))
    return s.orderBy(F.desc("merit"), "r", "c").limit(25)  # a ranking of the best sites


@query("J1_top_lines", sql("grid", f"SELECT r, {q6('dens')} AS dens FROM (SELECT r, avg((v > 0.12)::INT) AS dens FROM grid GROUP BY r ORDER BY dens DESC, r LIMIT 9) ORDER BY r"))
def j1(spark, d):
    per = derived.grid(spark, d).groupBy("r").agg(F.avg((c("v") > 0.12).cast("int")).alias("dens"))
    return per.orderBy(F.desc("dens"), "r").limit(9).orderBy("r").select("r", r6("dens").alias("dens"))


@query("J2_arg_min", sql("grid", f"SELECT c, arg_min(r, (v, r)) AS r, {q6('min(v)')} AS v FROM grid GROUP BY c"))
def j2(spark, d):
    return derived.grid(spark, d).groupBy("c").agg(F.min_by("r", F.struct("v", "r")).alias("r"), r6(F.min("v")).alias("v"))


@query("J3_subsample", sql("bands", f"""SELECT r, c, {q6('cpr')} AS cpr, {q6('dop')} AS dop, cpr > 0.5 AS hi FROM bands WHERE cpr IS NOT NULL AND dop IS NOT NULL
ORDER BY md5(r::VARCHAR || ',' || c::VARCHAR), r, c LIMIT 5000"""))
def j3(spark, d):
    """A sample without replacement whose flag stays with its pixel: the first 5000 by a hash of the place."""
    b = derived.bands(spark, d).select("r", "c", "cpr", "dop", (c("cpr") > 0.5).alias("hi")).filter("cpr is not null and dop is not null")
    return b.orderBy(F.md5(F.concat_ws(",", "r", "c")), "r", "c").limit(5000).select("r", "c", r6("cpr").alias("cpr"), r6("dop").alias("dop"), "hi")


@query("J4_even_rows", sql("grid size", f"SELECT r, {q6('avg(v)')} AS v FROM grid WHERE r IN (SELECT trunc(10 + k * (h - 20) / 6.0::DOUBLE)::INT FROM range(7) x(k), size) GROUP BY r"))
def j4(spark, d):
    """Seven lines evenly apart, ten from both ends of the grid."""
    rows = spark.createDataFrame([(r,) for r in peaks.even(shape(spark, d)[0], 10, 7)], "r int")
    return derived.grid(spark, d).join(F.broadcast(rows), "r", "left_semi").groupBy("r").agg(r6(F.avg("v")).alias("v"))


@query("K1_mask_union", sql("year", "SELECT r, c, lit FROM year"))
def k1(spark, d):
    """Lit at one of the suns at least: a pixel's masks are united where they are cast, tile by tile."""
    return sunlit(spark, d, SUNS).select("r", "c", "lit")


@query("K2_subset_check", sql("dpsr shadow", "SELECT count(*) AS n_outside FROM (SELECT r, c FROM dpsr EXCEPT SELECT r, c FROM shadow WHERE psr = 1)"))
def k2(spark, d):
    inside = derived.shadow(spark, d).filter("psr = 1").select("r", "c")
    return dpsr(spark, d).exceptAll(inside).agg(F.count(F.lit(1)).alias("n_outside"))


@query("K3_intersection", sql("bands", "SELECT r, c FROM bands WHERE cpr > 0.5 INTERSECT SELECT r, c FROM bands WHERE dop < 0.13"))
def k3(spark, d):
    b = derived.bands(spark, d)
    return b.filter("cpr > 0.5").select("r", "c").intersect(b.filter("dop < 0.13").select("r", "c"))


@query("K4_pooled", sql("pooled", f"SELECT count(*) AS n, {q6('avg(v)')} AS mean, {q6('quantile_cont(v, 0.99)')} AS p99 FROM pooled"))
def k4(spark, d):
    p = derived.pair(spark, d)
    v = p.select(c("a").alias("v")).union(p.select("b"))
    p99 = quantiles(v, ["v"], [0.99])["v"][0]
    return v.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean"), r6(F.lit(p99)).alias("p99"))


@query("K5_difference", sql("bands", "SELECT r, c FROM bands WHERE psr = 1 EXCEPT SELECT r, c FROM bands WHERE dpsr = 1"))
def k5(spark, d):
    b = derived.bands(spark, d)
    return b.filter("psr = 1").select("r", "c").subtract(b.filter("dpsr = 1").select("r", "c"))


@query("K6_distinct_files", "SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages ORDER BY path")
def k6(spark, d):
    return derived.table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")).distinct().orderBy("path")
