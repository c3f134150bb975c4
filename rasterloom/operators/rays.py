"""Ray casting as joins: ray tables, sun shadow, and visibility with a running horizon.

A ray table is a few rows (angles x steps, bounded by its parameters), so it is broadcast; observers meet it
without a shuffle and then find their target pixels by one equi-join. A ray that leaves the grid ends, which
the inner join does by itself: a ray is monotone in both axes and never re-enters. Every cast is two-phase:
short rays settle most observers, and only the survivors meet the rest of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.config import SETTINGS


def _steps(spark: SparkSession, n_angles: int, max_steps: int) -> DataFrame:
    a = spark.range(n_angles).select(F.col("id").cast("int").alias("a"), (F.col("id") * (2 * 3.141592653589793) / n_angles).alias("rad"))
    return a.select("a", "rad", F.explode(F.sequence(F.lit(1), F.lit(max_steps))).alias("k"))


def _distance(cell: float) -> Column:
    return F.greatest(F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) * cell, F.lit(1.0))


def bresenham_rays(spark: SparkSession, n_angles: int, max_steps: int, cell: float = SETTINGS.cell_m) -> DataFrame:
    """a, k, dr, dc, dist: pixels on the line to the ray's end point, one per step of its longer axis. The
    shorter axis stands at floor((2 k short + long) / (2 long)), in whole numbers."""
    s = _steps(spark, n_angles, max_steps)
    end_r, end_c = F.rint(max_steps * F.sin("rad")).cast("int"), F.rint(max_steps * F.cos("rad")).cast("int")
    s = s.select("a", "k", end_r.alias("er"), end_c.alias("ec")).select("*", F.abs("er").alias("ar"), F.abs("ec").alias("ac"))
    long, short = F.greatest("ar", "ac"), F.least("ar", "ac")
    minor = F.expr("cast((2L * k * least(ar, ac) + greatest(ar, ac)) div (2L * greatest(ar, ac)) as int)")
    wide = F.col("ac") >= F.col("ar")
    sign = lambda e: F.when(F.col(e) >= 0, 1).otherwise(-1)
    s = s.filter((F.col("k") <= long) & (short >= 0))
    s = s.select("a", "k", (F.when(wide, minor).otherwise(F.col("k")) * sign("er")).alias("dr"), (F.when(wide, F.col("k")).otherwise(minor) * sign("ec")).alias("dc"))
    return s.withColumn("dist", _distance(cell))


def rounded_rays(spark: SparkSession, n_angles: int, max_steps: int, cell: float = SETTINGS.cell_m) -> DataFrame:
    """a, k, dr, dc, dist by rounding each step half to even."""
    s = _steps(spark, n_angles, max_steps)
    s = s.select("a", "k", F.rint(F.sin("rad") * F.col("k")).cast("int").alias("dr"), F.rint(F.cos("rad") * F.col("k")).cast("int").alias("dc"))
    return s.withColumn("dist", _distance(cell))


def sun_rays(spark: SparkSession, azimuths: list[float], max_steps: int, cell: float = SETTINGS.cell_m) -> DataFrame:
    """a (index), k, dr, dc, dist towards the sun: azimuth 0 is north, 90 east, rows grow southwards."""
    az = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(float(x)).alias("az")) for i, x in enumerate(azimuths)])).alias("z")
    s = spark.range(1).select(az).select("z.a", F.radians("z.az").alias("rad"), F.explode(F.sequence(F.lit(1), F.lit(max_steps))).alias("k"))
    s = s.select("a", "k", F.rint(-F.cos("rad") * F.col("k")).cast("int").alias("dr"), F.rint(F.sin("rad") * F.col("k")).cast("int").alias("dc"))
    return s.withColumn("dist", _distance(cell))


def targets(observers: DataFrame, rays: DataFrame, grid: DataFrame) -> DataFrame:
    """Each observer's pixels along each ray. observers: r, c, z; grid: r, c and what a target shows (z, ...)."""
    looks = observers.select("r", "c", F.col("z").alias("z0")).crossJoin(F.broadcast(rays))
    looks = looks.withColumns({"tr": F.col("r") + F.col("dr"), "tc": F.col("c") + F.col("dc")})
    seen = grid.select(*[F.col(x).alias({"r": "tr", "c": "tc", "z": "z1"}.get(x, x)) for x in grid.columns])
    return looks.join(seen, ["tr", "tc"])


def shaded(observers: DataFrame, rays: DataFrame, grid: DataFrame, tan_elevation: float) -> DataFrame:
    """r, c, a of observers that some pixel of the ray hides from the sun."""
    hidden = targets(observers, rays, grid.select("r", "c", "z")).filter((F.col("z1") - F.col("z0")) / F.col("dist") >= tan_elevation)
    return hidden.select("r", "c", "a").distinct()


def illumination(dem: DataFrame, azimuths: list[float], elevation: float, max_steps: int, cell: float = SETTINGS.cell_m, near: int | None = None) -> DataFrame:
    """r, c, lit: 1 where the sun at some of the azimuths is not hidden. Near pixels are tried first; an
    observer and azimuth that they hide meets no more of the ray."""
    import math

    spark = dem.sparkSession
    tan = math.tan(math.radians(elevation))
    rays = sun_rays(spark, azimuths, max_steps, cell)
    near = min(near or max(1, max_steps // 4), max_steps)
    dark = shaded(dem, rays.filter(F.col("k") <= near), dem, tan)
    if near < max_steps:
        todo = dem.crossJoin(F.broadcast(rays.select("a").distinct())).join(dark, ["r", "c", "a"], "left_anti")
        far = rays.filter(F.col("k") > near)
        looks = todo.select("r", "c", F.col("z").alias("z0"), "a").join(F.broadcast(far), "a")
        looks = looks.withColumns({"tr": F.col("r") + F.col("dr"), "tc": F.col("c") + F.col("dc")})
        hit = looks.join(dem.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("z").alias("z1")), ["tr", "tc"])
        dark = dark.union(hit.filter((F.col("z1") - F.col("z0")) / F.col("dist") >= tan).select("r", "c", "a").distinct())
    n = dark.groupBy("r", "c").agg(F.countDistinct("a").alias("n_dark"))
    return dem.join(n, ["r", "c"], "left").select("r", "c", F.when(F.coalesce("n_dark", F.lit(0)) < len(azimuths), 1).otherwise(0).alias("lit"), F.coalesce("n_dark", F.lit(0)).cast("int").alias("n_dark"))


def curved_tan(radius: float = SETTINGS.moon_radius_m) -> Column:
    """Tangent of the elevation angle of a target over a sphere."""
    r1, r2, d = radius + F.col("z0"), radius + F.col("z1"), F.col("dist")
    return r1 * (r2 - F.sqrt(d * d + r1 * r1)) / (d * r2)


def flat_tan() -> Column:
    return (F.col("z1") - F.col("z0")) / F.col("dist")


def seeing(observers: DataFrame, rays: DataFrame, grid: DataFrame, tan: Column, target: Column) -> DataFrame:
    """r, c of observers that see a target: one on no lower a tangent than every closer pixel of its ray."""
    w = Window.partitionBy("r", "c", "a").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    looks = targets(observers, rays, grid).withColumn("tan", tan)
    looks = looks.withColumn("before", F.max("tan").over(w))
    return looks.filter(target & (F.col("tan") >= F.coalesce("before", F.lit(-1e18)))).select("r", "c").distinct()


def doubly_shadowed(shadow: DataFrame, rays: DataFrame, near: int, tan: Column | None = None, target: Column | None = None) -> DataFrame:
    """r, c of shadowed pixels (psr = 1) that see no target (psr = 0). A ray's first steps decide alone whether
    they see one, so that short rays go first and whole rays are cast from the rest only."""
    tan = curved_tan() if tan is None else tan
    target = F.col("psr") == 0 if target is None else target
    inside = shadow.filter("psr = 1").select("r", "c", "z")
    left = inside.join(seeing(inside, rays.filter(F.col("k") <= near), shadow, tan, target), ["r", "c"], "left_anti")
    return left.join(seeing(left, rays, shadow, tan, target), ["r", "c"], "left_anti").select("r", "c")


def scattered(grid: DataFrame, flags: DataFrame, name: str = "flag") -> DataFrame:
    """Flags of some pixels put back on the grid, 0 elsewhere."""
    return grid.select("r", "c").join(flags.select("r", "c", F.lit(1).alias(name)), ["r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
