"""As-of join: for each value the last key at or below it and the next one above, in one sorted pass over both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.sources.shared import written


def asof(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """v, with the last key at or below it (m, k) and the next one above (m2, k2); NULL where there is none. asked: v, each
    once; keys: m and k, ordered by m, equal ones by k (the last of equal ones counts as at or below).

    Both sides are dealt by range, so that a part holds what lies between two of its neighbours' values, and written
    with their part. Windows work inside parts; what they need from others is the first and the last key of each part, a
    row for every part that has keys, which the driver carries over. Work is that of one sort of both sides."""
    spark = asked.sparkSession
    key = F.when(F.col("own"), F.struct(F.col("v").alias("m"), "k"))
    rows = asked.select(F.col("v").cast("double").alias("v"), F.lit(False).alias("own"), F.lit(None).cast("long").alias("k"))
    rows = rows.union(keys.select(F.col("m").cast("double"), F.lit(True), F.col("k").cast("long"))).filter("v is not null and not isnan(v)")
    rows = written(rows.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "asof")
    ends = rows.filter("own").groupBy("part").agg(F.min(F.struct("v", "k")).alias("first"), F.max(F.struct("v", "k")).alias("last")).orderBy("part").collect()
    kind = "struct<m:double,k:bigint>"
    literal = lambda x: F.struct(F.lit(float(x["v"])).alias("m"), F.lit(int(x["k"])).alias("k")).cast(kind)

    def carried(which) -> F.Column:
        """By part, a key of another part."""
        pairs = [(r["part"], x) for r in parts if (x := which(r["part"])) is not None]
        return F.try_element_at(F.create_map(*[y for p, x in pairs for y in (F.lit(p), literal(x))]), F.col("part")) if pairs else F.lit(None).cast(kind)

    parts = [r for r in rows.select("part").distinct().collect()]  # as many as the session shuffles to
    before = carried(lambda p: next((r["last"] for r in reversed(ends) if r["part"] < p), None))
    after = carried(lambda p: next((r["first"] for r in ends if r["part"] > p), None))
    order = Window.partitionBy("part").orderBy("v", F.desc("own"), "k")  # a key comes before the values that equal it
    # what follows is what comes before the other way round: a frame that grows is read once, one that shrinks again for every row
    back = Window.partitionBy("part").orderBy(F.desc("v"), "own", F.desc("k"))
    here = rows.withColumn("key", key).select(
        "v", "own",
        F.coalesce(F.last("key", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), before).alias("low"),
        F.coalesce(F.last("key", True).over(back.rowsBetween(Window.unboundedPreceding, -1)), after).alias("high"),
    )
    return here.filter(~F.col("own")).select("v", F.col("low.m").alias("m"), F.col("low.k").alias("k"), F.col("high.m").alias("m2"), F.col("high.k").alias("k2"))
