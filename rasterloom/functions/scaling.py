"""Percentile stretches, mask normalisation and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.config import INVERTED, MASKS, SETTINGS, WEIGHTS
from rasterloom.operators.quantiles import quantiles


def limits(df: DataFrame, columns: list[str], low: float = SETTINGS.stretch_low, high: float = SETTINGS.stretch_high) -> DataFrame:
    """One row with <column>_lo and <column>_hi, the exact percentiles of valid values."""
    found = quantiles(df, columns, [low, high])
    names = [f"{c}_{x}" for c in columns for x in ("lo", "hi")]
    return df.sparkSession.createDataFrame([tuple(v for c in columns for v in found[c])], ", ".join(f"{n} double" for n in names))


def stretch(v: Column, lo: Column, hi: Column, constant: float, invert: bool = False) -> Column:
    """Clipped linear stretch to [0, 1]; a constant band becomes `constant`; NULL stays."""
    unit = F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    out = F.when(v.isNotNull(), F.when(hi - lo > 0, 1 - unit if invert else unit).otherwise(F.lit(constant)))
    return out


def mask01(v: Column) -> Column:
    return F.when(v.isNotNull(), F.when(v > 0, 1.0).otherwise(0.0))


def normalised(df: DataFrame, continuous: list[str], masks: list[str], inverted: tuple[str, ...] = INVERTED, constant: float = 0.5) -> DataFrame:
    """The bands stretched over the whole table. The limits are one row, broadcast."""
    lim = F.broadcast(limits(df, continuous))
    joined = df.crossJoin(lim)
    out = {c: stretch(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), constant, c in inverted) for c in continuous}
    out |= {c: mask01(F.col(c)) for c in masks}
    return joined.withColumns(out).drop(*lim.columns)


def score(weights: dict[str, float] = WEIGHTS) -> tuple[Column, Column]:
    """Weighted mean of the normalised bands that a pixel has (NULL without any), and how many it has."""
    total = weight = F.lit(0.0)
    n = F.lit(0)
    for band, w in weights.items():
        total = total + F.coalesce(F.col(band) * w, F.lit(0.0))
        weight = weight + F.when(F.col(band).isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        n = n + F.when(F.col(band).isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return F.when(weight > 0, total / weight), n


def confidence(bands: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The bands normalised, with score and n_valid."""
    cont = [b for b in weights if b not in MASKS and b in bands.columns]
    masks = [b for b in weights if b in MASKS and b in bands.columns]
    value, n = score({b: w for b, w in weights.items() if b in bands.columns})
    return normalised(bands, cont, masks).withColumn("score", value).withColumn("n_valid", n)


def log_rescaled(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, most: float = 2.0) -> DataFrame:
    """log10 of a column, its percentiles mapped to [0, most] and clipped; a constant band becomes the middle."""
    logs = df.withColumn(column, F.log10(F.col(column)))
    lim = F.broadcast(limits(logs, [column], low, high))
    lo, hi, v = F.col(f"{column}_lo"), F.col(f"{column}_hi"), F.col(column)
    unit = F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * most
    out = F.when(v.isNotNull(), F.when(hi > lo, unit).otherwise(F.lit(most / 2)))
    return logs.crossJoin(lim).withColumn(column, out).drop(*lim.columns)
