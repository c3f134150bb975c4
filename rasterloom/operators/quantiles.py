"""Exact quantiles of bands of any size.

The built-in exact percentile gathers every distinct value in one task. Here each level counts the values of
the open cells in equal bins (partial counts are summed, so that a task sends one row per bin) and keeps only
the bins that hold a wanted rank; after a few levels, what is left of a band fits FETCH values or is one
value. A level is one pass over the rows that are still in question. What comes to the driver is bounded by
ROWS bins a level and FETCH values at the end."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.stats import unpivot

ROWS = 65_536
FETCH = 20_000


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles by linear interpolation; None where a column has no value."""
    rows = unpivot(df, columns).filter("v is not null").withColumn("cell", F.lit(0).cast("long"))
    ends = {r["band"]: r for r in rows.groupBy("band").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    known: dict[tuple[str, int], float] = {}
    wanted = {b: sorted({k for p in probs for k in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))}) for b, r in ends.items()}
    # (band, cell) -> least and largest value, how many lie below, how many inside, ranks that are wanted
    cells = {(b, 0): (r["lo"], r["hi"], 0, r["n"], wanted[b]) for b, r in ends.items()}
    spark = df.sparkSession
    while True:
        for (b, _), (lo, hi, below, n, ranks) in cells.items():
            if lo == hi:
                known |= {(b, k): lo for k in ranks}
        cells = {key: x for key, x in cells.items() if x[0] < x[1]}
        if not cells:
            break
        marks = spark.createDataFrame([(b, cell, float(x[0]), float(x[1])) for (b, cell), x in cells.items()], "band string, cell long, lo double, hi double")
        rows = rows.select("band", "cell", "v").join(F.broadcast(marks), ["band", "cell"])
        if sum(x[3] for x in cells.values()) <= FETCH:
            values: dict[tuple[str, int], list[float]] = {}
            for r in rows.select("band", "cell", "v").collect():
                values.setdefault((r["band"], r["cell"]), []).append(r["v"])
            for (b, cell), (_, _, below, _, ranks) in cells.items():
                inside = sorted(values[b, cell])
                known |= {(b, k): inside[k - below] for k in ranks}
            break
        bins = max(16, ROWS // len(cells))
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        rows = rows.select("band", (F.col("cell") * bins + place).alias("cell"), "v")
        found = rows.groupBy("band", "cell").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        parts: dict[tuple[str, int], list] = {}
        for r in found.collect():
            parts.setdefault((r["band"], r["cell"] // bins), []).append(r)
        deeper = {}
        for (b, cell), (_, _, below, _, ranks) in cells.items():
            for r in sorted(parts[b, cell], key=lambda r: r["cell"]):
                inside = ranks[bisect_left(ranks, below) : bisect_left(ranks, below + r["n"])]
                if inside:
                    deeper[b, r["cell"]] = (r["lo"], r["hi"], below, r["n"], inside)
                below += r["n"]
        cells = deeper
    out: dict[str, list[float | None]] = {}
    for b in columns:
        out[b] = []
        for p in probs:
            if b not in ends:
                out[b].append(None)
                continue
            at = p * (ends[b]["n"] - 1)
            low, high = known[b, math.floor(at)], known[b, math.ceil(at)]
            out[b].append(low + (high - low) * (at - math.floor(at)))
    return out
