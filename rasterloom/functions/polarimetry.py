"""Polarimetric column expressions. A complex number is a pair of columns (re, im)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.config import SETTINGS

EPS = SETTINGS.eps


def complex_of(i: Column, q: Column) -> Column:
    return F.struct(i.alias("re"), q.alias("im"))


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def amplitude(re: Column, im: Column) -> Column:
    return F.sqrt(power(re, im))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def cross_pol(hv: tuple[Column, Column], vh: tuple[Column, Column]) -> tuple[Column, Column]:
    """Reciprocity: the mean of both cross channels, as fields."""
    return (hv[0] + vh[0]) / 2, (hv[1] + vh[1]) / 2


def circular(hh, vv, xp) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Same-sense and opposite-sense circular fields of linear ones: SC = (HH - VV) + 2j XP, OC = HH + VV."""
    sc = (hh[0] - vv[0]) - 2 * xp[1], (hh[1] - vv[1]) + 2 * xp[0]
    return sc, (hh[0] + vv[0], hh[1] + vv[1])


def cpr_fields(sc: Column, oc: Column, eps: float = EPS) -> Column:
    """Circular polarisation ratio of averaged powers; NULL where OC is not positive."""
    zero = F.lit(0.0)
    return F.when(oc > 0, F.greatest(sc, zero) / (F.greatest(oc, zero) + eps))


def cpr_intensity(hh: Column, vv: Column, xp: Column, eps: float = EPS) -> Column:
    """The intensity-only form, 1 at least; NULL for negative inputs or no co-polar power."""
    fine = (hh + vv > 0) & (hh >= 0) & (vv >= 0) & (xp >= 0)
    return F.when(fine, 1 + 4 * xp / (hh + vv + eps))


def mu_c(hh: Column, vv: Column, eps: float = EPS) -> Column:
    up, down = F.pow(F.sqrt(hh) + F.sqrt(vv), F.lit(2.0)), F.pow(F.sqrt(hh) - F.sqrt(vv), F.lit(2.0))
    return F.when((hh >= 0) & (vv >= 0) & (down >= eps), up / (down + eps))


def cpr_numbers(hh: Column, hv: Column, vh: Column, vv: Column, eps: float = EPS) -> Column:
    """Exploratory ratio on raw digital numbers; NULL where a co-polar number is 0."""
    co = hh * hh + vv * vv
    return F.when((hh != 0) & (vv != 0), (co + 2 * (hv * hv + vh * vh)) / (co + eps))


def number_to_db(dn: Column, k: float = SETTINGS.calibration_db) -> Column:
    return F.when(dn > 0, 20 * F.log10(dn) - k)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def to_power(dn: Column, fmt: Column, k: float = SETTINGS.calibration_db) -> Column:
    """Linear power by detected format: raw numbers are calibrated, decibels are undone, linear stays."""
    return (
        F.when(fmt == "raw_dn", db_to_linear(number_to_db(dn, k)))
        .when(fmt == "db", db_to_linear(dn)).when(fmt == "linear", F.when(dn >= 0, dn))
    )


def stokes(c11: Column, c22: Column, c12_re: Column, c12_im: Column) -> tuple[Column, Column, Column, Column]:
    """Stokes parameters of the H-transmit channel pair."""
    root2 = F.sqrt(F.lit(2.0))
    return c11 + c22 / 2, c11 - c22 / 2, root2 * c12_re, root2 * c12_im


def stokes_broken(s0: Column, s1: Column, s2: Column, s3: Column) -> Column:
    return F.sqrt(s1 * s1 + s2 * s2 + s3 * s3) > s0 * 1.0001


def dop_transmit(s0: Column, s1: Column, s2: Column, s3: Column, eps: float = EPS) -> Column:
    """Degree of polarisation of the H-transmit wave; NULL without power or beyond 1 by more than rounding."""
    d = F.sqrt(s1 * s1 + s2 * s2 + s3 * s3) / (s0 + eps)
    return F.when((s0 > 0) & (d <= 1 + 1e-6), F.least(d, F.lit(1.0)))


def dop_circular(sc: Column, oc: Column, cr: Column, ci: Column, eps: float = EPS) -> Column:
    """Degree of polarisation from circular powers and their cross term <SC conj(OC)>. Not dop_transmit."""
    d = F.sqrt(F.pow(oc - sc, F.lit(2.0)) + 4 * cr * cr + 4 * ci * ci) / (sc + oc + eps)
    return F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))


def dop_from_cpr(cpr: Column, eps: float = EPS) -> Column:
    return F.abs(1 - cpr) / (1 + cpr + eps)


def span_db(hh: Column, hv: Column, vv: Column, eps: float = EPS) -> Column:
    return 10 * F.log10(F.greatest(hh + 2 * hv + vv, F.lit(eps)))


def copol_db(hh: Column, vv: Column, eps: float = EPS) -> Column:
    return 10 * F.log10(hh / (vv + eps))


def xpol_fraction(hh: Column, hv: Column, vv: Column, eps: float = EPS) -> Column:
    return hv / (hh + vv + eps)
