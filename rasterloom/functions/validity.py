"""Null model and pixel predicates. Sentinels and NaN become NULL at the scan and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(v: Column, nodata: float | None) -> Column:
    """NULL for NaN, infinities and the nodata tag. A tag of 0 is a tag; None is no tag."""
    v = v.cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if nodata is not None:
        bad = bad | (v == F.lit(float(nodata)))
    return F.when(~bad, v)


def non_negative(v: Column) -> Column:
    return v.isNotNull() & (v >= 0)


def comparable(a: Column, b: Column, most: float = 20.0) -> Column:
    """Both values valid for a comparison: above 0, at most `most`."""
    return (a > 0) & (a <= most) & (b > 0) & (b <= most)


def roi_valid(oc: Column, cpr: Column, dop: Column, eps: float = 1e-10, most: float = 2.5) -> Column:
    return (oc > eps) & (cpr > 0) & (cpr <= most) & (dop >= 0) & (dop <= 1)


def ice_candidate(cpr: Column, dop: Column | None = None, cpr_from: float = 1.0, dop_below: float = 0.13) -> Column:
    test = cpr > cpr_from
    return test if dop is None else test & (dop < dop_below)


def rock_or_ice(cpr: Column, dop: Column, cold: Column) -> Column:
    """Decision tree: radar-bright, then depolarised, then in a cold trap."""
    return (
        F.when(cpr.isNull() | dop.isNull(), F.lit("unknown")).when(cpr <= 1.0, F.lit("background"))
        .when(dop >= 0.13, F.lit("rough rock")).when(cold, F.lit("ice")).otherwise(F.lit("bright, not cold"))
    )


def landing_site(ice: Column, slope: Column, least_ice: float = 0.6, most_slope: float = 15.0) -> Column:
    return (ice >= least_ice) & (slope <= most_slope)


def ice_probability(cpr_norm: Column, vol_norm: Column, psr: Column, dpsr: Column) -> Column:
    return cpr_norm * (1 - vol_norm) * psr * dpsr
