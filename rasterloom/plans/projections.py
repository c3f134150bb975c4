"""B: scalar maths, one pixel in, one pixel out."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.config import CRATERS, WEIGHTS
from rasterloom.functions import geodesy, labels, polarimetry as pol, scaling
from rasterloom.operators.compare import basic
from rasterloom.operators.stats import data_format
from rasterloom.plans.base import q6, query, r6, relation, sql
from rasterloom.sources import derived

c = F.col
EPS = "1e-10"
channel = lambda p: (c(f"{p}_re"), c(f"{p}_im"))

relation("fields", """SELECT r, c, hh_re + vv_re AS oc_re, hh_im + vv_im AS oc_im, hh_re - vv_re - (hv_im + vh_im) AS sc_re, hh_im - vv_im + (hv_re + vh_re) AS sc_im,
(hv_re + vh_re) / 2 AS xp_re, (hv_im + vh_im) / 2 AS xp_im, hh_re, hh_im, vv_re, vv_im FROM sli""", "sli")
relation("powers", """SELECT r, c, sc_re * sc_re + sc_im * sc_im AS sc, oc_re * oc_re + oc_im * oc_im AS oc, hh_re * hh_re + hh_im * hh_im AS hh, vv_re * vv_re + vv_im * vv_im AS vv,
xp_re * xp_re + xp_im * xp_im AS xp, sc_re * oc_re + sc_im * oc_im AS cr, sc_im * oc_re - sc_re * oc_im AS ci,
hh_re * xp_re + hh_im * xp_im AS c12_re, hh_im * xp_re - hh_re * xp_im AS c12_im FROM fields""", "fields")


def fields(spark, d):
    """The linear fields and those derived from them."""
    s = derived.sli(spark, d)
    xp = pol.cross_pol(channel("hv"), channel("vh"))
    sc, oc = pol.circular(channel("hh"), channel("vv"), xp)
    named = {"oc": oc, "sc": sc, "xp": xp}
    return s.select("*", *[x.alias(f"{k}_{p}") for k, z in named.items() for x, p in zip(z, ("re", "im"))])


def powers(spark, d):
    f = fields(spark, d)
    (sr, si), (o_r, oi), (hr, hi), (xr, xi) = channel("sc"), channel("oc"), channel("hh"), channel("xp")
    return f.select(
        "r", "c", *[pol.power(*channel(k)).alias(k) for k in ("sc", "oc", "hh", "vv", "xp")],
        (sr * o_r + si * oi).alias("cr"), (si * o_r - sr * oi).alias("ci"),
        (hr * xr + hi * xi).alias("c12_re"), (hi * xr - hr * xi).alias("c12_im"),
    )


def out(df, *keep, **named):
    digits = named.pop("digits", 6)
    return df.select("r", "c", *keep, *[r6(v, digits).alias(k) for k, v in named.items()])


@query("B1_complex", sql("sli", "SELECT r, c, {'re': hh_re, 'im': hh_im}.re AS re, {'re': hh_re, 'im': hh_im}.im AS im FROM sli"))
def b1(spark, d):
    z = derived.sli(spark, d).select("r", "c", pol.complex_of(c("hh_re"), c("hh_im")).alias("z"))
    return z.select("r", "c", "z.re", "z.im")


@query("B2_amplitude_power_phase", sql("sli", f"SELECT r, c, {q6('sqrt(hh_re * hh_re + hh_im * hh_im)')} AS amp, {q6('hh_re * hh_re + hh_im * hh_im')} AS pow, {q6('atan2(hh_im, hh_re)')} AS phase FROM sli"))
def b2(spark, d):
    z = channel("hh")
    return out(derived.sli(spark, d), amp=pol.amplitude(*z), pow=pol.power(*z), phase=pol.phase(*z))


@query("B3_cross_pol", sql("fields", f"SELECT r, c, {q6('xp_re', 9)} AS xp_re, {q6('xp_im', 9)} AS xp_im FROM fields"))
def b3(spark, d):
    return out(fields(spark, d), xp_re=c("xp_re"), xp_im=c("xp_im"), digits=9)


@query("B4_circular", sql("fields", f"SELECT r, c, {q6('sc_re', 9)} AS sc_re, {q6('sc_im', 9)} AS sc_im, {q6('oc_re', 9)} AS oc_re, {q6('oc_im', 9)} AS oc_im FROM fields"))
def b4(spark, d):
    return out(fields(spark, d), sc_re=c("sc_re"), sc_im=c("sc_im"), oc_re=c("oc_re"), oc_im=c("oc_im"), digits=9)


@query("B5_field_power", sql("powers", f"SELECT r, c, {q6('sc', 9)} AS sc, {q6('oc', 9)} AS oc FROM powers"))
def b5(spark, d):
    return out(powers(spark, d), sc=c("sc"), oc=c("oc"), digits=9)


@query("B6_cpr_fields", sql("powers", f"SELECT r, c, {q6(f'CASE WHEN oc > 0 THEN greatest(sc, 0) / (greatest(oc, 0) + {EPS}) END', 4)} AS cpr FROM powers"))
def b6(spark, d):
    return out(powers(spark, d), cpr=pol.cpr_fields(c("sc"), c("oc")), digits=4)


@query("B7_cpr_intensity", sql("powers", f"SELECT r, c, {q6(f'CASE WHEN hh + vv > 0 THEN 1 + 4 * xp / (hh + vv + {EPS}) END', 4)} AS cpr FROM powers"))
def b7(spark, d):
    return out(powers(spark, d), cpr=pol.cpr_intensity(c("hh"), c("vv"), c("xp")), digits=4)


_MU = f"CASE WHEN (sqrt(hh) - sqrt(vv)) ** 2 >= {EPS} THEN (sqrt(hh) + sqrt(vv)) ** 2 / ((sqrt(hh) - sqrt(vv)) ** 2 + {EPS}) END"


@query("B8_mu_c", sql("powers", f"SELECT r, c, {q6(f'log10({_MU})')} AS log_mu FROM powers"))
def b8(spark, d):
    return out(powers(spark, d), log_mu=F.log10(pol.mu_c(c("hh"), c("vv"))))


@query("B9_mu_c_rescaled", sql("powers", f"""WITH m AS (SELECT r, c, log10({_MU}) AS l FROM powers), q AS (SELECT quantile_cont(l, 0.01) AS lo, quantile_cont(l, 0.99) AS hi FROM m)
SELECT r, c, {q6('CASE WHEN l IS NOT NULL THEN CASE WHEN hi > lo THEN least(greatest((l - lo) / (hi - lo), 0), 1) * 2 ELSE 1 END END')} AS mu FROM m, q"""))
def b9(spark, d):
    raw = powers(spark, d).select("r", "c", pol.mu_c(c("hh"), c("vv")).alias("mu"))
    return out(scaling.log_rescaled(raw, "mu"), mu=c("mu"))


@query("B10_cpr_numbers", sql("numbers", f"SELECT r, c, lid, {q6(f'CASE WHEN hh <> 0 AND vv <> 0 THEN (hh * hh + vv * vv + 2 * (hv * hv + vh * vh)) / (hh * hh + vv * vv + {EPS}) END')} AS cpr FROM numbers"))
def b10(spark, d):
    return out(derived.numbers(spark, d), "lid", cpr=pol.cpr_numbers(c("hh"), c("hv"), c("vh"), c("vv")))


@query("B11_number_to_db", sql("numbers", f"SELECT r, c, lid, {q6('CASE WHEN hh > 0 THEN 20 * log10(hh) - 70.308868::DOUBLE END')} AS db FROM numbers"))
def b11(spark, d):
    return out(derived.numbers(spark, d), "lid", db=pol.number_to_db(c("hh")))


@query("B12_db_to_linear", sql("numbers", f"SELECT r, c, lid, {q6('10 ** ((hh / 10 - 10) / 10)')} AS lin FROM numbers"))
def b12(spark, d):
    return out(derived.numbers(spark, d), "lid", lin=pol.db_to_linear(c("hh") / 10 - 10))


_FMT = """CASE WHEN n = 0 THEN 'raw_dn' WHEN neg / n > 0.05 AND lo > -100 AND hi < 50 THEN 'db' WHEN lo >= 0 AND hi < 100 THEN 'linear' ELSE 'raw_dn' END"""


@query("B13_to_power", sql("numbers", f"""WITH f AS (SELECT {_FMT} AS fmt FROM (SELECT count(*) AS n, count(*) FILTER (hh < 0) AS neg, min(hh) AS lo, max(hh) AS hi FROM numbers WHERE hh <> 0))
SELECT r, c, lid, fmt, {q6('''1e6 * CASE fmt WHEN 'raw_dn' THEN CASE WHEN hh > 0 THEN 10 ** ((20 * log10(hh) - 70.308868::DOUBLE) / 10) END WHEN 'db' THEN 10 ** (hh / 10) ELSE CASE WHEN hh >= 0 THEN hh END END''')} AS micro FROM numbers, f"""))
def b13(spark, d):
    n = derived.numbers(spark, d)
    fmt = F.broadcast(data_format(n, "hh").select("fmt"))
    return out(n.crossJoin(fmt), "lid", "fmt", micro=1e6 * pol.to_power(c("hh"), c("fmt")))


@query("B14_cross_power_mean", sql("bands", f"SELECT r, c, {q6('(cpr + dop) / 2')} AS xp FROM bands"))
def b14(spark, d):
    return out(derived.bands(spark, d), xp=(c("cpr") + c("dop")) / 2)


_S = "hh + 2 * xp / 2 AS s0, hh - 2 * xp / 2 AS s1, sqrt(2.0::DOUBLE) * sqrt(2.0::DOUBLE) * c12_re AS s2, sqrt(2.0::DOUBLE) * sqrt(2.0::DOUBLE) * c12_im AS s3"
relation("covariance", "SELECT r, c, hh AS c11, 2 * xp AS c22, vv AS c33, sqrt(2.0::DOUBLE) * c12_re AS c12_re, sqrt(2.0::DOUBLE) * c12_im AS c12_im, hh + 2 * xp + vv AS span FROM powers", "powers")
relation("stokes", "SELECT r, c, c11 + c22 / 2 AS s0, c11 - c22 / 2 AS s1, sqrt(2.0::DOUBLE) * c12_re AS s2, sqrt(2.0::DOUBLE) * c12_im AS s3 FROM covariance", "covariance")


def covariance(spark, d):
    """Single-look covariance terms of the H-transmit pair (the cross channel counts twice)."""
    root2 = F.sqrt(F.lit(2.0))
    return powers(spark, d).select(
        "r", "c", c("hh").alias("c11"), (2 * c("xp")).alias("c22"), c("vv").alias("c33"),
        (root2 * c("c12_re")).alias("c12_re"), (root2 * c("c12_im")).alias("c12_im"), (c("hh") + 2 * c("xp") + c("vv")).alias("span"),
    )


def stokes(df):
    s = pol.stokes(c("c11"), c("c22"), c("c12_re"), c("c12_im"))
    return df.select("r", "c", *[x.alias(f"s{i}") for i, x in enumerate(s)])


@query("B15_stokes", sql("stokes", f"SELECT r, c, {', '.join(q6(f's{i}') + f' AS s{i}' for i in range(4))}, (sqrt(s1 * s1 + s2 * s2 + s3 * s3) > s0 * 1.0002) AS broken FROM stokes"))
def b15(spark, d):
    s = stokes(covariance(spark, d))
    wide = F.sqrt(c("s1") * c("s1") + c("s2") * c("s2") + c("s3") * c("s3")) > c("s0") * 1.0002
    return s.select("r", "c", *[r6(f"s{i}").alias(f"s{i}") for i in range(4)], wide.alias("broken"))


_DOP = f"sqrt(s1 * s1 + s2 * s2 + s3 * s3) / (s0 + {EPS})"


@query("B16_dop_transmit", sql("bands", f"""WITH s AS (SELECT r, c, tmean / 100 AS s0, cpr / 10 AS s1, dop AS s2, slope / 40 AS s3 FROM bands)
SELECT r, c, {q6(f'CASE WHEN s0 > 0 AND {_DOP} <= 1 + 1e-6 THEN least({_DOP}, 1) END')} AS dop FROM s"""))
def b16(spark, d):
    b = derived.bands(spark, d)
    return out(b, dop=pol.dop_transmit(c("tmean") / 100, c("cpr") / 10, c("dop"), c("slope") / 40))


@query("B17_dop_circular", sql("powers", f"SELECT r, c, {q6(f'least(greatest(sqrt((oc - sc) ** 2 + 4 * cr * cr + 4 * ci * ci) / (sc + oc + {EPS}), 0), 1)', 5)} AS dop FROM powers"))
def b17(spark, d):
    return out(powers(spark, d), dop=pol.dop_circular(c("sc"), c("oc"), c("cr"), c("ci")), digits=5)


@query("B18_dop_from_cpr", sql("bands", f"SELECT r, c, {q6(f'abs(1 - abs(cpr)) / (1 + abs(cpr) + {EPS})')} AS dop FROM bands"))
def b18(spark, d):
    return out(derived.bands(spark, d), dop=pol.dop_from_cpr(F.abs("cpr")))


@query("B19_span_ratios", sql("powers", f"SELECT r, c, {q6(f'10 * log10(greatest(hh + 2 * xp + vv, {EPS}))')} AS span_db, {q6(f'10 * log10(hh / (vv + {EPS}))')} AS copol_db, {q6(f'xp / (hh + vv + {EPS})')} AS xpol FROM powers"))
def b19(spark, d):
    hh, xp, vv = c("hh"), c("xp"), c("vv")
    return out(powers(spark, d), span_db=pol.span_db(hh, xp, vv), copol_db=pol.copol_db(hh, vv), xpol=pol.xpol_fraction(hh, xp, vv))


def coherency(spark, d):
    """Single-look terms of T3 (upper triangle)."""
    f = fields(spark, d)
    dr, di = c("hh_re") - c("vv_re"), c("hh_im") - c("vv_im")
    o_r, oi, xr, xi = c("oc_re"), c("oc_im"), c("xp_re"), c("xp_im")
    return f.select(
        "r", "c", ((o_r * o_r + oi * oi) / 2).alias("t11"), ((dr * dr + di * di) / 2).alias("t22"), (2 * (xr * xr + xi * xi)).alias("t33"),
        ((o_r * dr + oi * di) / 2).alias("t12r"), ((oi * dr - o_r * di) / 2).alias("t12i"),
        (o_r * xr + oi * xi).alias("t13r"), (oi * xr - o_r * xi).alias("t13i"),
        (dr * xr + di * xi).alias("t23r"), (di * xr - dr * xi).alias("t23i"),
    )




R = "1737400.0::DOUBLE"
_RHO = f"2 * {R} * tan(pi() / 4 + radians(lat) / 2)"
relation("plane", f"SELECT n, lat, lon, {_RHO} * sin(radians(lon)) AS x, {_RHO} * cos(radians(lon)) AS y FROM ties", "ties")


def plane(spark, d):
    x, y = geodesy.to_plane(c("lat"), c("lon"))
    return derived.ties(spark, d).select("n", "lat", "lon", x.alias("x"), y.alias("y"))


@query("B21_stereographic", sql("plane", f"SELECT n, {q6('x', 3)} AS x, {q6('y', 3)} AS y FROM plane"))
def b21(spark, d):
    return plane(spark, d).select("n", r6("x", 3).alias("x"), r6("y", 3).alias("y"))


@query("B22_gnomonic", sql("ties", f"SELECT n, {q6(f'{R} * tan(radians(90 - abs(lat)))', 3)} AS reach FROM ties"))
def b22(spark, d):
    return derived.ties(spark, d).select("n", r6(geodesy.gnomonic_reach(c("lat")), 3).alias("reach"))


@query("B23_affine", sql("plane", """SELECT n, floor((y - 320000.5) / -1280)::INT AS r_floor, floor((x + 320000.5) / 10000)::INT AS c_floor,
round_even((y - 320000.5) / -1280, 0)::INT AS r_near, round_even((x + 320000.5) / 10000, 0)::INT AS c_near FROM plane"""))
def b23(spark, d):
    p = plane(spark, d)
    rf, cf = geodesy.cell_floor(c("x"), c("y"), -320000.5, 320000.5, 10000.0, -1280.0)
    rn, cn = geodesy.cell_nearest(c("x"), c("y"), -320000.5, 320000.5, 10000.0, -1280.0)
    return p.select("n", rf.alias("r_floor"), cf.alias("c_floor"), rn.alias("r_near"), cn.alias("c_near"))


_HAV = f"2 * 1737.4::DOUBLE * asin(least(sqrt(sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2), 1))"
_CRATERS = ", ".join(f"('{n}', {la}::DOUBLE, {lo}::DOUBLE, {di}::DOUBLE)" for n, la, lo, di in CRATERS)
relation("craters", f"SELECT * FROM (VALUES {_CRATERS}) t(crater, lat2, lon2, diam)")


def craters(spark):
    return spark.createDataFrame(CRATERS, "crater string, lat2 double, lon2 double, diam double")


@query("B24_haversine", sql("ties craters", f"SELECT n, crater, {q6(_HAV)} AS km FROM ties, craters"))
def b24(spark, d):
    t = derived.ties(spark, d).crossJoin(F.broadcast(craters(spark)))
    return t.select("n", "crater", r6(geodesy.haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2"))).alias("km"))


@query("B25_great_circle", sql("ties craters", f"""SELECT n, crater, {q6('degrees(acos(greatest(least(sin(radians(lat)) * sin(radians(lat2)) + cos(radians(lat)) * cos(radians(lat2)) * cos(radians(lon - lon2)), 1), -1)))', 4)} AS deg FROM ties, craters"""))
def b25(spark, d):
    t = derived.ties(spark, d).crossJoin(F.broadcast(craters(spark)))
    return t.select("n", "crater", r6(geodesy.great_circle_deg(c("lat"), c("lon"), c("lat2"), c("lon2")), 4).alias("deg"))


_CONT = ["cpr", "dop", "tmean", "zit", "pump", "slope"]
_LIMITS = ", ".join(f"quantile_cont({b}, 0.01) AS {b}_lo, quantile_cont({b}, 0.99) AS {b}_hi" for b in _CONT)
relation("limits", f"SELECT {_LIMITS} FROM bands", "bands")


def _stretch(b: str, constant: str, invert: bool = False) -> str:
    u = f"least(greatest(({b} - {b}_lo) / ({b}_hi - {b}_lo), 0), 1)"
    return f"CASE WHEN {b} IS NULL THEN NULL WHEN {b}_hi > {b}_lo THEN {'1 - ' + u if invert else u} ELSE {constant} END"


relation("normal", "SELECT r, c, " + ", ".join(f"{_stretch(b, '0.5', b in ('dop', 'tmean', 'zit', 'slope'))} AS {b}" for b in _CONT) + ", CASE WHEN psr > 0 THEN 1.0::DOUBLE ELSE 0 END AS psr, CASE WHEN dpsr > 0 THEN 1.0::DOUBLE ELSE 0 END AS dpsr FROM bands, limits", "bands limits")
_W = {b: f"{w}::DOUBLE" for b, w in WEIGHTS.items()}
_TOP, _BOTTOM = " + ".join(f"coalesce({b} * {w}, 0)" for b, w in _W.items()), " + ".join(f"CASE WHEN {b} IS NULL THEN 0 ELSE {w} END" for b, w in _W.items())
relation("scored", f"SELECT r, c, ({_TOP}) / ({_BOTTOM}) AS score, ({' + '.join(f'({b} IS NOT NULL)::INT' for b in _W)})::INT AS n_valid FROM normal", "normal")


@query("B26_stretch_fusion", sql("normal", f"SELECT r, c, {', '.join(q6(b) + f' AS {b}' for b in _CONT)} FROM normal"))
def b26(spark, d):
    n = scaling.normalised(derived.bands(spark, d), _CONT, [])
    return out(n, **{b: c(b) for b in _CONT})


@query("B27_stretch_cube", sql("bands limits", f"SELECT r, c, {', '.join(q6(_stretch(b, '0')) + f' AS {b}' for b in ('cpr', 'zit'))}, {q6('0 * zit')} AS flat FROM bands, limits"))
def b27(spark, d):
    b = derived.bands(spark, d).withColumn("flat", F.lit(3.0))
    n = scaling.normalised(b, ["cpr", "zit", "flat"], [], inverted=(), constant=0.0)
    return out(n, cpr=c("cpr"), zit=c("zit"), flat=c("flat"))


@query("B28_mask", sql("bands", "SELECT r, c, CASE WHEN dop IS NULL THEN NULL WHEN dop > 0.1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM bands"))
def b28(spark, d):
    return derived.bands(spark, d).select("r", "c", scaling.mask01(c("dop") - 0.1).alias("m"))


@query("B29_confidence", sql("scored", f"SELECT r, c, {q6('score')} AS score, n_valid FROM scored"))
def b29(spark, d):
    s = scaling.confidence(derived.bands(spark, d))
    return s.select("r", "c", r6("score").alias("score"), "n_valid")


@query("B30_difference", sql("bands", f"SELECT r, c, {q6('cpr - official')} AS diff, {q6('abs(cpr - official)')} AS adiff FROM bands"))
def b30(spark, d):
    return out(derived.bands(spark, d), diff=c("cpr") - c("official"), adiff=F.abs(c("cpr") - c("official")))


@query("B31_grades", sql("pair", """WITH m AS (SELECT corr(a, b) AS r, avg(a - b) AS bias FROM pair)
SELECT CASE WHEN r >= 0.9 THEN 'excellent' WHEN r >= 0.7 THEN 'good' WHEN r >= 0.5 THEN 'moderate' WHEN r >= 0 THEN 'poor' ELSE 'unknown' END AS agreement,
CASE WHEN abs(bias) < 0.05 THEN 'negligible' WHEN abs(bias) < 0.15 THEN 'small' ELSE 'substantial' END AS bias,
CASE WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN abs(r) >= 0.1 THEN 'weak' ELSE 'negligible' END AS strength FROM m"""))
def b31(spark, d):
    m = derived.pair(spark, d).agg(*basic())
    return m.select(labels.grade("pearson_r", c("pearson_r")).alias("agreement"), labels.bias_grade(c("bias")).alias("bias"), labels.strength(c("pearson_r")).alias("strength"))
