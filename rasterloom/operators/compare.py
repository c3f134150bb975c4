"""Metrics that compare two co-registered rasters, columns a (calculated) and b (official)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.focal import box_sums
from rasterloom.operators.stats import histogram, histogram2d
from rasterloom.sources.shared import written

def basic() -> list:
    """n, Pearson r, RMSE, MAE, bias and R2 (against b), as aggregates."""
    d = F.col("a") - F.col("b")
    return [
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("pearson_r"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
        (1 - F.sum(d * d) / F.nullif(F.var_pop("b") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    ]


def ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """column's distinct values with their average rank. Values are counted first, dealt by range, and ranked
    inside their range; only one total per range meets in one place, so no window holds all values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    dealt = written(counts.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranks")
    totals = dealt.groupBy("_p").agg(F.sum("_n").alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))
    w = Window.partitionBy("_p").orderBy(column)
    inner = dealt.select("*", F.sum("_n").over(w).alias("_s")).join(F.broadcast(before), "_p")
    return inner.select(column, (F.col("_b") + F.col("_s") - (F.col("_n") - 1) / 2.0).alias(name))


def spearman(df: DataFrame) -> DataFrame:
    """Pearson correlation of average ranks."""
    both = df.select("a", "b").join(ranks(df, "a", "ra"), "a").join(ranks(df, "b", "rb"), "b")
    return both.agg(F.corr("ra", "rb").alias("spearman_r"))


def intersection(df: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """Shared area of the two normalised histograms."""
    h = {x: histogram(df, x, lo, hi, n).withColumnRenamed("n", f"n{x}") for x in ("a", "b")}
    shares = [(F.coalesce(f"n{x}", F.lit(0)) / F.sum(F.coalesce(f"n{x}", F.lit(0))).over(Window.partitionBy())) for x in ("a", "b")]
    return h["a"].join(h["b"], "bin", "full").select(F.least(*shares).alias("m")).agg(F.sum("m").alias("overlap"))


def mutual_information(df: DataFrame, lo: float = 0.0, hi: float = 3.0, n: int = 100) -> DataFrame:
    """Normalised by the root of the product of both entropies; natural logarithm."""
    cells = histogram2d(df, "a", "b", lo, hi, n)
    p = cells.select("bx", "by", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    p = p.select("p", F.sum("p").over(Window.partitionBy("bx")).alias("px"), F.sum("p").over(Window.partitionBy("by")).alias("py"))
    mi = F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py"))))
    # each cell has its share of the marginal entropies
    ha, hb = -F.sum(F.col("p") * F.log("px")), -F.sum(F.col("p") * F.log("py"))
    return p.agg((mi / F.nullif(F.sqrt(ha * hb), F.lit(0.0))).alias("nmi"))


def ssim(df: DataFrame, shape: tuple[int, int], valid: Column | None = None, size: int = 7) -> DataFrame:
    """Mean structural similarity over the pixels whose window lies inside; sample moments, K1 .01, K2 .03, the
    range is that of b. With valid, the bounding box of the pixels that both rasters have is looked at, and other
    pixels in it take the means of those; without it, a and b must have no gaps. All pixels count, at any size."""
    h, w = shape
    n, half = size * size, size // 2
    a, b = F.col("a"), F.col("b")
    edges = {"top": F.min("r"), "bottom": F.max("r"), "left": F.min("c"), "right": F.max("c"), "mean_a": F.avg("a"), "mean_b": F.avg("b")}
    if valid is None:
        df = df.select("r", "c", "a", "b").crossJoin(df.sparkSession.range(1).select(*[F.lit(x).alias(k) for k, x in zip(edges, (0, h - 1, 0, w - 1))]))
    else:
        box = df.filter(valid).agg(*[e.alias(k) for k, e in edges.items()])
        df = df.select("r", "c", *[F.when(valid, F.col(x)).alias(x) for x in "ab"]).crossJoin(F.broadcast(box))
        df = df.filter(F.col("r").between(F.col("top"), F.col("bottom")) & F.col("c").between(F.col("left"), F.col("right")))
        df = df.withColumns({"a": F.coalesce("a", "mean_a"), "b": F.coalesce("b", "mean_b")})
    df = df.select("r", "c", "a", "b", *list(edges)[:4])
    parts = df.select("r", "c", "a", "b", (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab"))
    s = box_sums(parts, ["a", "b", "aa", "bb", "ab"], (size, size), shape, reflect=False)
    frame = F.broadcast(df.agg(F.greatest(F.max("b") - F.min("b"), F.lit(1e-6)).alias("span"), *[F.first(k).alias(k) for k in list(edges)[:4]]))
    s = s.crossJoin(frame)
    s = s.filter(F.col("r").between(F.col("top") + half, F.col("bottom") - half) & F.col("c").between(F.col("left") + half, F.col("right") - half))
    ma, mb = F.col("a") / n, F.col("b") / n
    va, vb, cab = (F.col("aa") / n - ma * ma) * n / (n - 1), (F.col("bb") / n - mb * mb) * n / (n - 1), (F.col("ab") / n - ma * mb) * n / (n - 1)
    c1, c2 = F.pow(0.01 * F.col("span"), F.lit(2.0)), F.pow(0.03 * F.col("span"), F.lit(2.0))
    v = (2 * ma * mb + c1) * (2 * cab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return s.agg(F.avg(v).alias("ssim"))


def pairwise_correlation(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """x, y, n, r of every pair of bands over the pixels where both are valid; NULL under `least` pixels or
    without spread. All pairs in one aggregation."""
    aggs, names = [], []
    for i, x in enumerate(columns):
        for y in columns[i:]:
            both = F.col(x).isNotNull() & F.col(y).isNotNull()
            k = len(names)
            p, q = F.when(both, F.col(x)), F.when(both, F.col(y))
            spread = (F.stddev_pop(p) > 0) & (F.stddev_pop(q) > 0) & (F.count_if(both) >= least)
            aggs += [F.count_if(both).alias(f"n{k}"), F.when(spread, F.corr(p, q)).alias(f"r{k}")]
            names.append((x, y))
    one = df.agg(*aggs)
    rows = ", ".join(f"'{x}', '{y}', n{k}, r{k}" for k, (x, y) in enumerate(names))
    return one.selectExpr(f"stack({len(names)}, {rows}) as (x, y, n, r)")


def log_gamma(x: Column) -> Column:
    """Stirling's series, after eight steps up."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def correlation_p(r: Column, n: Column, rounds: int = 400) -> Column:
    """Two-sided p of a correlation of n pairs without a true one: the incomplete beta function at 1 - r * r, by its
    continued fraction, folded inside one expression. NULL under three pairs."""
    a, b, x = (n - 2) / 2.0, F.lit(0.5), 1 - r * r
    late = x >= (a + 1) / (a + b + 2)
    q, u, v = F.when(late, 1 - x).otherwise(x), F.when(late, b).otherwise(a), F.when(late, a).otherwise(b)
    safe = lambda z: F.when(F.abs(z) < 1e-300, F.lit(1e-300)).otherwise(z)

    def more(acc: Column, k: Column) -> Column:
        m, q, u, v = F.floor((k + 1) / 2), acc["q"], acc["u"], acc["v"]  # two steps a round
        one, two = m * (v - m) * q / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * q / ((u + 2 * m) * (u + 2 * m + 1))
        num = F.when(k % 2 == 1, one).otherwise(two)
        after = F.struct((1 + num * acc["d"]).alias("d"), (1 + num / acc["c"]).alias("c"))
        let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
        return let(after, lambda x: let(F.struct((1 / safe(x["d"])).alias("d"), safe(x["c"]).alias("c")), lambda y: F.struct(
            y["c"].alias("c"), y["d"].alias("d"), (acc["f"] * y["c"] * y["d"]).alias("f"), q.alias("q"), u.alias("u"), v.alias("v"))))

    begin = F.struct(F.lit(1.0).alias("c"), (1 / safe(1 - (u + v) * q / (u + 1))).alias("d"), (1 / safe(1 - (u + v) * q / (u + 1))).alias("f"), q.alias("q"), u.alias("u"), v.alias("v"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds)), begin, more)["f"]
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + b * F.log(1 - x))
    value = front * fraction / u
    return F.when(n < 3, None).when(F.abs(r) >= 1, F.lit(0.0)).when(r == 0, F.lit(1.0)).otherwise(F.when(late, 1 - value).otherwise(value))


def t_test_p(r: float, n: int) -> float:
    """The same for one pair of numbers on the driver."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    x, a, b = 1 - r * r, df / 2, 0.5  # df / (df + t^2)

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        out = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
