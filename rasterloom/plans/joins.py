"""C and D: predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.config import SETTINGS
from rasterloom.functions import geodesy, polarimetry as pol, validity
from rasterloom.operators import joins, ray_tiles, rays as ray_ops
from rasterloom.operators import polygons
from rasterloom.operators.resample import nearest
from rasterloom.plans.base import q6, query, r6, relation, sql
from rasterloom.plans.projections import _HAV, craters, plane, powers
from rasterloom.sources import derived

c = F.col


@query("C1_valid_pixel", sql("bands", f"SELECT r, c, {q6('dop')} AS dop FROM bands WHERE dop IS NOT NULL AND dop <> 0.5"))
def c1(spark, d):
    b = derived.bands(spark, d).withColumn("dop", validity.canonical(c("dop"), 0.5))
    return b.filter(c("dop").isNotNull()).select("r", "c", r6("dop").alias("dop"))


@query("C2_cpr_valid", sql("bands", f"SELECT r, c, {q6('cpr')} AS cpr FROM bands WHERE cpr >= 0"))
def c2(spark, d):
    return derived.bands(spark, d).filter(validity.non_negative(c("cpr"))).select("r", "c", r6("cpr").alias("cpr"))


@query("C3_overlap", sql("pair", f"SELECT r, c, {q6('a')} AS a, {q6('b')} AS b FROM pair"))
def c3(spark, d):
    return derived.pair(spark, d).select("r", "c", r6("a").alias("a"), r6("b").alias("b"))


@query("C4_roi_valid", sql("powers", f"""WITH m AS (SELECT r, c, oc, sc / (oc + 1e-10) AS cpr, least(greatest(sqrt((oc - sc) ** 2 + 4 * cr * cr + 4 * ci * ci) / (sc + oc + 1e-10), 0), 1) AS dop FROM powers)
SELECT r, c, {q6('cpr')} AS cpr FROM m WHERE oc > 1e-10 AND cpr > 0 AND cpr <= 2.5 AND dop BETWEEN 0 AND 1"""))
def c4(spark, d):
    p = powers(spark, d)
    m = p.select("r", "c", "oc", (c("sc") / (c("oc") + 1e-10)).alias("cpr"), pol.dop_circular(c("sc"), c("oc"), c("cr"), c("ci")).alias("dop"))
    return m.filter(validity.roi_valid(c("oc"), c("cpr"), c("dop"))).select("r", "c", r6("cpr").alias("cpr"))


@query("C5_zoom_valid", sql("powers", f"""SELECT r, c, {q6('CASE WHEN oc > 1e-10 AND sc / (oc + 1e-10) > 0 AND sc / (oc + 1e-10) < 10 THEN sc / (oc + 1e-10) END')} AS cpr FROM powers"""))
def c5(spark, d):
    v = c("sc") / (c("oc") + 1e-10)
    return powers(spark, d).select("r", "c", r6(F.when((c("oc") > 1e-10) & (v > 0) & (v < 10), v)).alias("cpr"))


@query("C6_ice_candidates", sql("bands", "SELECT r, c, coalesce(dop < 0.13, false) AS joint FROM bands WHERE cpr > 0.5"))
def c6(spark, d):
    b = derived.bands(spark, d).filter(validity.ice_candidate(c("cpr"), cpr_from=0.5))
    return b.select("r", "c", F.coalesce(validity.ice_candidate(c("cpr"), c("dop"), cpr_from=0.5), F.lit(False)).alias("joint"))


@query("C7_rock_or_ice", sql("bands", """SELECT CASE WHEN cpr IS NULL OR dop IS NULL THEN 'unknown' WHEN cpr * 2 <= 1 THEN 'background' WHEN dop >= 0.13 THEN 'rough rock'
WHEN (psr > 0 OR dpsr > 0) AND coalesce(tmean < 110, false) THEN 'ice' ELSE 'bright, not cold' END AS kind, count(*) AS n FROM bands GROUP BY 1"""))
def c7(spark, d):
    cold = ((c("psr") > 0) | (c("dpsr") > 0)) & F.coalesce(c("tmean") < 110, F.lit(False))
    return derived.bands(spark, d).groupBy(validity.rock_or_ice(c("cpr") * 2, c("dop"), cold).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("C8_landing_sites", sql("scored bands", f"SELECT r, c, {q6('score')} AS score FROM scored JOIN bands USING (r, c) WHERE score >= 0.5 AND slope <= 4"))
def c8(spark, d):
    from rasterloom.functions.scaling import confidence

    b = derived.bands(spark, d)
    s = confidence(b.withColumn("raw", c("slope")))
    return s.filter(validity.landing_site(c("score"), c("raw"), 0.5, 4.0)).select("r", "c", r6("score").alias("score"))


@query("C9_ice_probability", sql("normal", f"SELECT r, c, {q6('cpr * (1 - pump) * psr * dpsr')} AS p FROM normal"))
def c9(spark, d):
    from rasterloom.functions.scaling import confidence

    s = confidence(derived.bands(spark, d))
    return s.select("r", "c", r6(validity.ice_probability(c("cpr"), c("pump"), c("psr"), c("dpsr"))).alias("p"))


@query("C10_ice_volume", sql("normal", f"SELECT {q6('sum(400.0::DOUBLE * 2) FILTER (cpr * (1 - pump) >= 0.5)')} AS m3, count(*) FILTER (cpr * (1 - pump) >= 0.5) AS n FROM normal"))
def c10(spark, d):
    from rasterloom.functions.scaling import confidence

    rich = c("cpr") * (1 - c("pump")) >= 0.5
    return confidence(derived.bands(spark, d)).agg(r6(F.sum(F.when(rich, 800.0))).alias("m3"), F.count_if(rich).alias("n"))


@query("C11_latitude_band", sql("ties", "SELECT min(n // 9) AS first_line, max(n // 9) AS last_line, count(*) AS n FROM ties WHERE lat BETWEEN -89.5 AND -89"))
def c11(spark, d):
    t = derived.ties(spark, d).filter(c("lat").between(-89.5, -89.0))
    line = F.floor(c("n") / 9)
    return t.agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count(F.lit(1)).alias("n"))


#: Circles on the grid: name, row, column, radius in pixels.
CIRCLES = [("alpha", 100, 20, 12), ("beta", 250, 40, 18), ("gamma", 400, 5, 9), ("delta", 110, 30, 15), ("edge", 0, 63, 10)]
relation("circles", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {r}, {k}, {q})" for n, r, k, q in CIRCLES) + ") t(crater, r0, c0, radius)")


def circles(spark):
    return spark.createDataFrame(CIRCLES, "crater string, r0 int, c0 int, radius int")


@query("C12_circle", sql("grid circles", f"SELECT crater, r, c, {q6('v')} AS v FROM grid JOIN circles ON (r - r0) ** 2 + (c - c0) ** 2 <= radius * radius"))
def c12(spark, d):
    return joins.in_circles(derived.grid(spark, d), circles(spark)).select("crater", "r", "c", r6("v").alias("v"))


#: Rings of a customer's polygon: how often a key has it (all, each third, each fifth), and its points in sizes from its middle.
RINGS = [
    (1, [(-1.0, -1.0), (1.0, -0.7), (0.9, 1.0), (-0.8, 0.8)]),
    (3, [(-0.3, -0.3), (0.4, -0.2), (0.1, 0.4)]),  # a hole
    (5, [(2.0, 0.0), (3.0, 0.3), (2.5, 1.0)]),  # another part
]
_RING = " UNION ALL ".join("SELECT poly, [" + ", ".join(f"{{'x': cx + s * {x!r}::DOUBLE, 'y': cy + s * {y!r}::DOUBLE}}" for x, y in ring) + f"] AS p FROM middles WHERE poly % {every} = 0" for every, ring in RINGS)
relation("middles", "SELECT c_custkey AS poly, c_custkey * 37 % 641 / 10::DOUBLE AS cx, c_custkey * 7919 % 1009 / 1009::DOUBLE * h AS cy, 0.5::DOUBLE + abs(c_acctbal) / 10000 AS s FROM customer, size", "size")
relation("sides", f"""SELECT poly, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM (SELECT poly, unnest(list_transform(p, lambda q, i: {{'a': q, 'b': p[i % len(p) + 1]}}), recursive := false) AS s FROM ({_RING})), LATERAL (SELECT s.a AS a, s.b AS b)""", "middles")


def customer_sides(spark, d):
    """A polygon for each customer, some with a hole and some of two parts, all over the grid."""
    h, k = derived.table(spark, d, "embeddings").count(), c("c_custkey")
    m = derived.table(spark, d, "customer").select(
        k.alias("poly"), (k * 37 % 641 / F.lit(10.0)).alias("cx"), (k * 7919 % 1009 / F.lit(1009.0) * h).alias("cy"), (0.5 + F.abs("c_acctbal") / 10000).alias("s")
    )
    ring = lambda points: F.array(*[F.struct((c("cx") + c("s") * x).alias("x"), (c("cy") + c("s") * y).alias("y")) for x, y in points])
    rings = F.filter(F.array(*[F.when(c("poly") % every == 0, ring(points)) for every, points in RINGS]), lambda r: r.isNotNull())
    return polygons.sides_of(m.select("poly", F.explode(rings).alias("p")), "poly", "p")


relation("cut", "SELECT r, poly, x1 + (r + 0.5 - y1) / (y2 - y1) * (x2 - x1) AS x FROM (SELECT DISTINCT r FROM grid), sides WHERE (y1 > r + 0.5) <> (y2 > r + 0.5)", "grid sides")
relation("inner_pixels", "SELECT g.r, g.c, coalesce(max(k), 0)::INT AS inside FROM grid g LEFT JOIN (SELECT g.r, g.c, poly, count(*) % 2 AS k FROM grid g JOIN cut ON cut.r = g.r AND g.c + 0.5 < cut.x GROUP BY g.r, g.c, poly) i ON i.r = g.r AND i.c = g.c GROUP BY g.r, g.c", "grid cut")


@query("C13_polygon_distance", sql("grid sides inner_pixels", f"""WITH p AS (SELECT r, c, c + 0.5 AS x, r + 0.5 AS y FROM grid),
s AS (SELECT x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS q FROM sides),
t AS (SELECT r, c, x - x1 AS ex, y - y1 AS ey, dx, dy, greatest(least(((x - x1) * dx + (y - y1) * dy) / q, 1), 0) AS u FROM p, s),
g AS (SELECT r, c, sqrt(min((ex - u * dx) * (ex - u * dx) + (ey - u * dy) * (ey - u * dy))) AS distance FROM t GROUP BY r, c)
SELECT r, c, inside, {q6('distance')} AS distance FROM inner_pixels JOIN g USING (r, c)"""))
def c13(spark, d):
    p, sides = derived.grid(spark, d).select("r", "c"), customer_sides(spark, d)
    near = polygons.border_distance(p, sides, c("c") + 0.5, c("r") + 0.5)
    return polygons.covered(p, sides).join(near, ["r", "c"]).select("r", "c", "inside", r6("distance").alias("distance"))


@query("D1_aligned_bands", sql("bands", f"SELECT r, c, {q6('cpr')} AS cpr, {q6('dop')} AS dop, {q6('tmean')} AS tmean FROM bands WHERE cpr IS NOT NULL AND dop IS NOT NULL AND tmean IS NOT NULL"))
def d1(spark, d):
    b = derived.bands(spark, d)
    parts = [b.select("r", "c", n).filter(c(n).isNotNull()) for n in ("cpr", "dop", "tmean")]
    return joins.aligned(parts).select("r", "c", *[r6(n).alias(n) for n in ("cpr", "dop", "tmean")])


EIGHT = ["cpr", "dop", "tmean", "zit", "pump", "slope", "psr", "dpsr"]


@query("D1_bucketed_bands", sql("bands", f"SELECT r, c, {', '.join(q6(n) + f' AS {n}' for n in EIGHT)} FROM bands WHERE {' AND '.join(f'{n} IS NOT NULL' for n in EIGHT)}"))
def d1_bucketed(spark, d):
    """Eight bands of one grid, each written in buckets once, that meet without a shuffle."""
    b, buckets = derived.bands(spark, d), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [joins.bucketed(b.select("r", "c", n).filter(c(n).isNotNull()), f"band_{n}", buckets) for n in EIGHT]
    return joins.aligned(parts).select("r", "c", *[r6(n).alias(n) for n in EIGHT])


@query("D2_optional_bands", sql("bands", f"SELECT r, c, {q6('zit')} AS zit, {q6('dop')} AS dop FROM bands"))
def d2(spark, d):
    b = derived.bands(spark, d)
    out = joins.aligned([b.select("r", "c", "zit"), b.select("r", "c", "dop").filter("dop is not null")], "left")
    return out.select("r", "c", r6("zit").alias("zit"), r6("dop").alias("dop"))


def _rays(n: int, steps: int, most: int) -> str:
    """The first `most` steps of n line rays that are `steps` long."""
    turn = f"a * 2 * pi() / {n}"
    return f"""SELECT a::INT AS a, k::INT AS k, dr::INT AS dr, dc::INT AS dc, greatest(sqrt(dr * dr + dc * dc) * 20, 1)::DOUBLE AS dist FROM (
SELECT a, k, CASE WHEN abs(ec) >= abs(er) THEN (2 * k * abs(er) + abs(ec)) // (2 * abs(ec)) ELSE k END * CASE WHEN er >= 0 THEN 1 ELSE -1 END AS dr,
CASE WHEN abs(ec) >= abs(er) THEN k ELSE (2 * k * abs(ec) + abs(er)) // (2 * abs(er)) END * CASE WHEN ec >= 0 THEN 1 ELSE -1 END AS dc
FROM (SELECT a, k, round_even({steps} * sin({turn}), 0)::INT AS er, round_even({steps} * cos({turn}), 0)::INT AS ec FROM range({n}) x(a), range(1, {most + 1}) y(k)) WHERE k <= greatest(abs(er), abs(ec))), size
WHERE abs(dr) < h AND abs(dc) < w"""


def _looks(observers: str, rays: str) -> str:
    return f"""SELECT o.r, o.c, a, k, dist, o.z AS z0, g.z AS z1, g.psr AS tpsr
FROM (SELECT r, c, z, a, k, dist, r + dr AS tr, c + dc AS tc FROM {observers} CROSS JOIN {rays}) o JOIN shadow g ON g.r = tr AND g.c = tc"""


def _sees(looks: str) -> str:
    """Observers that see a pixel out of the shadow."""
    return f"""SELECT DISTINCT r, c FROM (SELECT *, max(tan) OVER (PARTITION BY r, c, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
SELECT *, (1737400 + z0) * (1737400 + z1 - sqrt(dist * dist + (1737400 + z0) * (1737400 + z0))) / (dist * (1737400 + z1)) AS tan FROM ({looks}))) WHERE tpsr = 0 AND tan >= coalesce(before, -1e18)"""


relation("around", _rays(8, 8, 8), "size")
relation("rays", _rays(SETTINGS.n_angles, SETTINGS.max_distance, SETTINGS.max_distance), "size")
relation("dark", "SELECT * FROM shadow WHERE psr = 1", "shadow")
# most observers are settled by their first steps; the rest cast whole rays
relation("unsettled", f"SELECT * FROM dark ANTI JOIN ({_sees(_looks('dark', '(SELECT * FROM rays WHERE k <= 4)'))}) USING (r, c)", "dark rays")
relation("dpsr", f"SELECT r, c FROM unsettled ANTI JOIN ({_sees(_looks('unsettled', 'rays'))}) USING (r, c)", "unsettled rays shadow")


@query("D3_ray_join", sql("dark rays", f"SELECT a, k, count(*) AS n, {q6('sum(z1 - z0)', 3)} AS rise FROM ({_looks('dark', 'rays')}) GROUP BY a, k"))
def d3(spark, d):
    table = ray_tiles.inside(ray_tiles.bresenham_table(SETTINGS.n_angles, SETTINGS.max_distance), derived.table(spark, d, "embeddings").count(), derived.WIDTH)
    return ray_tiles.looks(derived.shadow(spark, d), table).select("a", "k", "n", r6("rise", 3).alias("rise"))


@query("D4_blind_observers", sql("dark around", f"SELECT r, c FROM dark ANTI JOIN (SELECT r, c FROM ({_looks('dark', '(SELECT * FROM around WHERE k = 1)')}) WHERE tpsr = 0) USING (r, c)"))
def d4(spark, d):
    s = derived.shadow(spark, d)
    seen = ray_ops.targets(s.filter("psr = 1"), ray_ops.bresenham_rays(spark, 8, 8).filter("k = 1"), s).filter("psr = 0")
    return s.filter("psr = 1").join(seen.select("r", "c").distinct(), ["r", "c"], "left_anti").select("r", "c")


@query("D5_mosaic_sample", sql("plane grid", f"""SELECT n, {q6('v')} AS v FROM (SELECT n, round_even((y - 320000.5) / -1280, 0)::INT AS pr, round_even((x + 320000.5) / 10000, 0)::INT AS pc FROM plane)
LEFT JOIN grid ON r = pr AND c = pc"""))
def d5(spark, d):
    p = plane(spark, d)
    row, col = geodesy.cell_nearest(c("x"), c("y"), -320000.5, 320000.5, 10000.0, -1280.0)
    return nearest(p, derived.grid(spark, d), "v", row, col).select("n", r6("v").alias("v"))


_CONV = "SELECT crater, lat2, l AS lon2, k AS convention FROM craters, (VALUES (0), (1), (2)) t(k), LATERAL (SELECT CASE k WHEN 0 THEN lon2 WHEN 1 THEN lon2 - 360 ELSE -lon2 END AS l)"


@query("D6_nearest_tie", sql("ties craters", f"""WITH v AS ({_CONV}), h AS (SELECT crater, convention, n, {_HAV} AS km FROM ties, v),
b AS (SELECT *, row_number() OVER (PARTITION BY crater ORDER BY round(km, 6), convention, n) AS k FROM h)
SELECT crater, convention, n, {q6('km')} AS km FROM b WHERE k = 1"""))
def d6(spark, d):
    conv = craters(spark).select("crater", "lat2", F.posexplode(F.array(c("lon2"), c("lon2") - 360, -c("lon2"))).alias("convention", "lon2"))
    pairs = derived.ties(spark, d).crossJoin(F.broadcast(conv))
    km = geodesy.haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2"))
    best = joins.nearest_by(pairs, ["crater"], F.round(km, 6), ["convention", "n"])
    return best.select("crater", "convention", "n", r6("distance").alias("km"))


@query("D7_nearest_row", sql("ties", f"SELECT arg_min(n, (abs(lat + 87.3::DOUBLE), n)) AS n, {q6('min(abs(lat + 87.3::DOUBLE))')} AS gap FROM ties"))
def d7(spark, d):
    gap = F.abs(c("lat") + 87.3)
    return derived.ties(spark, d).agg(F.min_by("n", F.struct(gap, "n")).alias("n"), r6(F.min(gap)).alias("gap"))


@query("D8_crater_regions", sql("shadow circles", f"SELECT crater, r, c, psr, {q6('z')} AS z FROM shadow JOIN circles ON (r - r0) ** 2 + (c - c0) ** 2 <= radius * radius"))
def d8(spark, d):
    return joins.in_circles(derived.shadow(spark, d), circles(spark)).select("crater", "r", "c", "psr", r6("z").alias("z"))


CENTRES = [40, 120, 200, 333, 470]


@query("D9_patches", sql("grid", f"""SELECT centre, r - centre + 15 AS pr, c, {q6('v')} AS v FROM grid JOIN (SELECT unnest({CENTRES}) AS centre) ON r BETWEEN centre - 15 AND centre + 14"""))
def d9(spark, d):
    centres = spark.createDataFrame([(x,) for x in CENTRES], "centre int")
    g = derived.grid(spark, d).join(F.broadcast(centres), c("r").between(c("centre") - 15, c("centre") + 14))
    return g.select("centre", (c("r") - c("centre") + 15).alias("pr"), "c", r6("v").alias("v"))


@query("D10_scatter", sql("grid", "SELECT r, c, CASE WHEN v > 0.2 THEN 1 ELSE 0 END AS flag FROM grid"))
def d10(spark, d):
    g = derived.grid(spark, d)
    return ray_ops.scattered(g, g.filter("v > 0.2"))


@query("D11_reachable", sql("shadow", f"""WITH n AS (SELECT r, c, r - max(CASE WHEN psr = 0 THEN r END) OVER (PARTITION BY c ORDER BY r) AS up, min(CASE WHEN psr = 0 THEN r END) OVER (PARTITION BY c ORDER BY r DESC) - r AS down FROM shadow)
SELECT o.r, o.c, coalesce(bool_or((n.c - o.c) ** 2 + least(coalesce(up, 1000000), coalesce(down, 1000000)) ** 2 <= {SETTINGS.max_distance} ** 2), false) AS reachable FROM shadow o JOIN n ON n.r = o.r WHERE o.psr = 1 GROUP BY o.r, o.c"""))
def d11(spark, d):
    s = derived.shadow(spark, d)
    return joins.within(s, c("psr") == 0, SETTINGS.max_distance).filter("psr = 1").select("r", "c", c("within").alias("reachable"))
