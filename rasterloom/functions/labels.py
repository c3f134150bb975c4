"""Text: constants in product labels, product names in file names, verdicts on metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.config import PRODUCTS, UNKNOWN_PRODUCT


def tagged_constant(text: Column, tag: str, fallback: float) -> Column:
    """The number between <tag> and </tag>, else the fallback."""
    found = F.regexp_extract(text, rf"<{tag}>\s*([-\d.eE]+)\s*</{tag}>", 1)
    return F.coalesce(found.try_cast("double"), F.lit(fallback))


def product_label(stem: Column) -> Column:
    """The label of a file name: its sixth token if that is a product code, else the first code that it
    contains, else a readable label of its first 24 characters."""
    token = F.lower(F.get(F.split(stem, "_"), F.lit(5)))
    out = F.concat(F.lit(UNKNOWN_PRODUCT), F.substring(stem, 1, 24))
    for code, label in reversed(PRODUCTS.items()):
        out = F.when(F.lower(stem).contains(code), F.lit(label)).otherwise(out)
    for code, label in PRODUCTS.items():
        out = F.when(token == code, F.lit(label)).otherwise(out)
    return out


#: Grades of agreement, from the best.
GRADES = {
    "pearson_r": [(0.90, "excellent"), (0.70, "good"), (0.50, "moderate"), (0.0, "poor")],
    "ssim": [(0.80, "high"), (0.60, "moderate"), (0.0, "low")],
    "hist_intersection": [(0.80, "very similar"), (0.60, "moderately similar"), (0.0, "dissimilar")],
}


def grade(metric: str, value: Column) -> Column:
    out = F.lit("unknown")
    for least, text in reversed(GRADES[metric]):
        out = F.when(value >= least, F.lit(text)).otherwise(out)
    return out


def bias_grade(value: Column) -> Column:
    return F.when(F.abs(value) < 0.05, F.lit("negligible")).when(F.abs(value) < 0.15, F.lit("small")).otherwise(F.lit("substantial"))


def strength(value: Column) -> Column:
    a = F.abs(value)
    return F.when(a >= 0.5, F.lit("strong")).when(a >= 0.3, F.lit("moderate")).when(a >= 0.1, F.lit("weak")).otherwise(F.lit("negligible"))
