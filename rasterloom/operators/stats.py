"""Descriptive statistics of bands: exact, in one aggregation where possible, never sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def unpivot(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """band, v (and keys): one row per pixel and band."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (band, v)")


def summary(v: Column) -> list[Column]:
    """min, max, mean, population deviation, counts."""
    return [
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_total"),
    ]


def band_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """The summary of each band, with its exact median."""
    from rasterloom.operators.quantiles import quantiles

    middle = [(b, q[0]) for b, q in quantiles(df, columns, [0.5]).items()]
    medians = F.broadcast(df.sparkSession.createDataFrame(middle, "band string, median double"))
    out = unpivot(df, columns).groupBy("band").agg(*summary(F.col("v"))).join(medians, "band", "left")
    return out.withColumn("valid_pct", 100.0 * F.col("n_valid") / F.col("n_total"))


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """pct, v by linear interpolation."""
    from rasterloom.operators.quantiles import quantiles

    found = quantiles(df, [column], [p / 100 for p in at])[column]
    return df.sparkSession.createDataFrame(list(zip(map(float, at), found)), "pct double, v double")


def bin_of(v: Column, lo: float, hi: float, n: int) -> Column:
    """Index of the equal bin that holds v; the last bin is closed; NULL outside."""
    i = F.floor((v - lo) / ((hi - lo) / n))
    return F.when((v >= lo) & (v <= hi), F.least(i, F.lit(n - 1))).cast("int")


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int) -> DataFrame:
    """bin, n of every bin that has pixels."""
    return df.select(bin_of(F.col(column), lo, hi, n).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, lo: float, hi: float, n: int) -> DataFrame:
    both = df.select(bin_of(F.col(x), lo, hi, n).alias("bx"), bin_of(F.col(y), lo, hi, n).alias("by"))
    return both.filter("bx is not null and by is not null").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def data_format(df: DataFrame, column: str) -> DataFrame:
    """fmt: db, linear or raw_dn, from one aggregation over the non-zero values."""
    v = F.when(F.col(column) != 0, F.col(column))
    one = df.agg(F.count(v).alias("n"), F.count_if(v < 0).alias("neg"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    share = F.col("neg") / F.nullif(F.col("n"), F.lit(0))
    fmt = (
        F.when(F.col("n") == 0, "raw_dn").when((share > 0.05) & (F.col("lo") > -100) & (F.col("hi") < 50), "db")
        .when((F.col("lo") >= 0) & (F.col("hi") < 100), "linear").otherwise("raw_dn")
    )
    return one.select(fmt.alias("fmt"), "n", "neg", "lo", "hi")


def block_mean(df: DataFrame, column: str, f: int, h: int, w: int) -> DataFrame:
    """Means of f x f blocks; rows and columns beyond the last whole block are left out."""
    inside = df.filter((F.col("r") < h // f * f) & (F.col("c") < w // f * f))
    return inside.groupBy(F.floor(F.col("r") / f).cast("int").alias("br"), F.floor(F.col("c") / f).cast("int").alias("bc")).agg(F.avg(column).alias(column))
