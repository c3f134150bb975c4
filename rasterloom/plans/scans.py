"""A: scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rasterloom.functions.labels import product_label, tagged_constant
from rasterloom.functions.polarimetry import power
from rasterloom.operators.resample import tie_group
from rasterloom.operators.stats import band_stats
from rasterloom.plans.base import q6, query, r6, sql
from rasterloom.sources import derived, rasters, tiff
from rasterloom.sources.manifest import made_once
from rasterloom.sources.shared import run_dir

c = F.col


def shape(spark, d) -> tuple[int, int]:
    """Lines and columns of the derived grid, from metadata alone."""
    return derived.table(spark, d, "embeddings").count(), derived.WIDTH


@query("A1_dem_scan", sql("dem", f"SELECT r, c, {q6('z')} AS z FROM dem"))
def a1(spark, d):
    return derived.dem(spark, d).select("r", "c", r6("z").alias("z"))


#: Lines of a raw file; every other file is in metres, the rest in kilometres.
RAW_LINES = 40


@query("A2_raw_float_scan", sql("grid", f"""WITH f AS (SELECT r, c, r // {RAW_LINES} AS file, (v * 4 * CASE WHEN r // {RAW_LINES} % 2 = 1 THEN 1000 ELSE 1 END)::FLOAT::DOUBLE AS x FROM grid WHERE r >= 20),
m AS (SELECT file, max((v * 4 * CASE WHEN r // {RAW_LINES} % 2 = 1 THEN 1000 ELSE 1 END)::FLOAT::DOUBLE) AS top FROM (SELECT *, r // {RAW_LINES} AS file FROM grid) GROUP BY file)
SELECT r, c, {q6('x * CASE WHEN top < 50 THEN 1000 ELSE 1 END', 3)} AS z FROM f JOIN m USING (file)"""))
def a2(spark, d):
    """Raw files of 32-bit floats behind a header, read from line 20 on; a file's greatest value tells its unit."""
    path = f"{run_dir(spark)}/raw-{uuid.uuid4().hex}"
    heights = derived.grid(spark, d).withColumn("v", c("v") * 4 * F.when(F.floor(c("r") / RAW_LINES) % 2 == 1, 1000).otherwise(1))
    tiff.write_raster(heights, path, shape(spark, d), RAW_LINES, layout="raw")
    back = tiff.read_raster(spark, path, layout="raw", kilometres="auto", rows="20,2147483647")
    return back.select("r", "c", r6("v", 3).alias("z"))


@query("A3_mask_scan", sql("shadow size", """SELECT count(*) AS pixels, sum(psr)::BIGINT AS n_psr, any_value(h * w) = count(*) AS shape_ok,
count(*) FILTER (psr NOT IN (0, 1)) AS n_odd FROM shadow, size"""))
def a3(spark, d):
    s = derived.shadow(spark, d)
    return s.agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("psr").alias("n_psr"),
        ((F.max("r") + 1) * (F.max("c") + 1) == F.count(F.lit(1))).alias("shape_ok"), F.count_if(~F.col("psr").isin(0, 1)).alias("n_odd"),
    )


@query("A4_complex_scan", sql("sli", "SELECT r, c, hh_re AS re, hh_im AS im FROM sli"))
def a4(spark, d):
    return derived.sli(spark, d).select("r", "c", F.col("hh_re").alias("re"), F.col("hh_im").alias("im"))


@query("A5_power_scan", sql("sli", f"SELECT r, c, {q6('hh_re * hh_re + hh_im * hh_im', 9)} AS p FROM sli"))
def a5(spark, d):
    return derived.sli(spark, d).select("r", "c", r6(power(F.col("hh_re"), F.col("hh_im")), 9).alias("p"))


@query("A6_band_scan", sql("numbers", "SELECT r, c, lid, hh FROM numbers"))
def a6(spark, d):
    return derived.numbers(spark, d).select("r", "c", "lid", "hh")


_LABEL = "CASE WHEN doc_id % 3 = 0 THEN 'no label' ELSE '<isda:calibration_constant> ' || n_chars || '.5 </isda:calibration_constant>' END"


@query("A7_label_constant", f"""
SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract({_LABEL}, '<isda:calibration_constant>\\s*([-\\d.eE]+)\\s*</isda:calibration_constant>', 1), '') AS DOUBLE), 70.308868::DOUBLE) AS k
FROM documents""")
def a7(spark, d):
    docs = derived.table(spark, d, "documents")
    label = F.when(F.col("doc_id") % 3 == 0, F.lit("no label")).otherwise(F.concat(F.lit("<isda:calibration_constant> "), "n_chars", F.lit(".5 </isda:calibration_constant>")))
    return docs.select("doc_id", tagged_constant(label, "isda:calibration_constant", 70.308868).alias("k"))


@query("A8_geometry_scan", sql("ties", """
SELECT min(n) + 1 AS n_rng, count_all // (min(n) + 1) AS n_az, count_all AS total FROM (
  SELECT n, slant, lead(slant) OVER (ORDER BY n) AS nx, count(*) OVER () AS count_all FROM ties) WHERE nx - slant < -500 GROUP BY count_all"""))
def a8(spark, d):
    """From CSV files in file order, whose columns are named as instruments name them."""
    path = f"{run_dir(spark)}/geometry-{uuid.uuid4().hex}"
    named = derived.ties(spark, d).orderBy("n").select(c("slant").alias("Slant_Range (m)"), c("lat").alias("Latitude"), c("lon").alias("Longitude"))
    named.write.csv(path, header=True)  # files by range, their names in order
    return tie_group(rasters.read_geometry(spark, path))


@query("A9_window_scan", sql("grid", f"SELECT r, c, {q6('v')} AS v FROM grid WHERE r BETWEEN 100 AND 199 AND c BETWEEN 10 AND 40"))
def a9(spark, d):
    return derived.grid(spark, d, (100, 199), (10, 40)).select("r", "c", r6("v").alias("v"))


@query("A10_convert_nodata", sql("grid", f"""
SELECT r, count(*) FILTER (v > 0.2) AS n_null, {q6('sum(v) FILTER (v <= 0.2)')} AS total FROM grid GROUP BY r"""))
def a10(spark, d):
    """Written with a nodata value, which is NULL when read."""
    path = f"{run_dir(spark)}/nodata-{uuid.uuid4().hex}"
    tagged = derived.grid(spark, d).withColumn("v", F.when(F.col("v") > 0.2, -9999.0).otherwise(F.col("v")))
    tiff.write_raster(rasters.converted(tagged, "v", -9999.0), path, shape(spark, d), 256, nodata=-9999.0)
    return tiff.read_raster(spark, path).groupBy("r").agg(F.count_if(F.col("v").isNull()).alias("n_null"), r6(F.sum("v")).alias("total"))


@query("A11_metadata", sql("grid bands", " UNION ALL ".join(f"""
SELECT '{name}' AS band, max(c) + 1 AS width, max(r) + 1 AS height, count(*) AS pixels, count({v}) AS n_valid, {q6(f'min({v})')} AS min, {q6(f'max({v})')} AS max, {q6(f'avg({v})')} AS mean,
'{derived.FRAME.crs}' AS crs, {derived.FRAME.step}::DOUBLE AS res, {derived.FRAME.left}::DOUBLE AS "left", {derived.FRAME.top} - (max(r) + 1) * {derived.FRAME.step}::DOUBLE AS bottom,
{derived.FRAME.left} + (max(c) + 1) * {derived.FRAME.step}::DOUBLE AS "right", {derived.FRAME.top}::DOUBLE AS top, 'double' AS dtype, {nodata}::DOUBLE AS nodata FROM {source}"""
    for name, v, source, nodata in (("dem", "v", "grid", "NULL"), ("cpr", "cpr", "bands", "-9999")))))
def a11(spark, d):
    return entries(spark, d).withColumns({x: r6(x) for x in ("min", "max", "mean")})


def entries(spark, d):
    """The catalogue of two products, the second of which borrows its coordinate system."""
    bands = {"dem": derived.grid(spark, d), "cpr": derived.bands(spark, d).select("r", "c", c("cpr").alias("v"))}
    return rasters.catalog(bands, {"dem": derived.FRAME, "cpr": derived.BARE}, derived.FRAME)


@query("A12_discovery", sql("grid", "SELECT DISTINCT (r // 64)::INT AS tile FROM grid WHERE r // 64 <> 1"))
def a12(spark, d):
    """The tiles whose files are found under a folder, but for one folder."""
    path = f"{run_dir(spark)}/tiles-{uuid.uuid4().hex}"
    rasters.write_tiles(derived.grid(spark, d), path, 64)
    found = rasters.discover(spark, path).filter(rasters.wanted(c("path"), ("parquet",), ("tile_r=1",)))
    return found.select(F.regexp_extract("path", r"/tile_r=(\d+)/", 1).cast("int").alias("tile")).distinct()


_CODES = ["cpr", "srd", "odd", "vol", "hlx", "evn", "trt", "gri", "sli", "sri", "zzz", "XCPRX"]
_STEM = "'ch2_sar_ncxl_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '_' ELSE '_d_' END || [" + ", ".join(f"'{x}'" for x in _CODES) + "][doc_id % 12 + 1] || '_xx'"


@query("A13_product_label", f"""
WITH s AS (SELECT doc_id, {_STEM} AS stem FROM documents),
k AS (SELECT * FROM (VALUES (1, 'cpr'), (2, 'srd'), (3, 'odd'), (4, 'vol'), (5, 'hlx'), (6, 'evn'), (7, 'trt'), (8, 'gri'), (9, 'sli'), (10, 'sri')) t(i, code))
SELECT doc_id, coalesce((SELECT upper(code) FROM k WHERE code = lower(string_split(stem, '_')[6])),
  (SELECT upper(arg_min(code, i)) FROM k WHERE contains(lower(stem), code)), 'DFSAR_' || stem[1:24]) AS label FROM s""")
def a13(spark, d):
    docs = derived.table(spark, d, "documents")
    n = F.col("doc_id")
    code = F.get(F.array(*map(F.lit, _CODES)), (n % 12).cast("int"))
    stem = F.concat(F.lit("ch2_sar_ncxl_"), n.cast("string"), F.when(n % 7 == 0, "_").otherwise("_d_"), code, F.lit("_xx"))
    return docs.select("doc_id", product_label(stem).alias("label"))


@query("A14_tiled_sink", sql("grid", f"SELECT (r // 64)::INT AS tile, count(*) AS n, {q6('sum(v)')} AS total FROM grid WHERE r BETWEEN 60 AND 300 GROUP BY 1"))
def a14(spark, d):
    """Blocks of 64 lines as files, of which a window of lines is read back."""
    path = f"{run_dir(spark)}/blocks-{uuid.uuid4().hex}"
    tiff.write_raster(derived.grid(spark, d), path, shape(spark, d), 64)
    back = tiff.read_raster(spark, path, (60, 300))
    return back.groupBy(F.floor(F.col("r") / 64).cast("int").alias("tile")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v")).alias("total"))


_BANDS = ["cpr", "dop", "tmean", "zit", "pump", "slope"]
_ONE = " UNION ALL ".join(f"SELECT '{b}' AS band, {b} AS v FROM bands" for b in _BANDS)


@query("A15_statistics_csv", sql("bands", f"SELECT band, count(v) AS n_valid, {q6('avg(v)')} AS mean FROM ({_ONE}) GROUP BY band"))
def a15(spark, d):
    stats = band_stats(derived.bands(spark, d), _BANDS).select("band", "n_valid", r6("mean").alias("mean"))
    path = f"{run_dir(spark)}/statistics-{uuid.uuid4().hex}"
    stats.write.csv(path, header=True)
    return spark.read.schema("band string, n_valid long, mean double").csv(path, header=True)


@query("A16_json_sidecar", sql("bands", f"SELECT to_json({{'band': band, 'n_valid': count(v), 'n_total': count(*)}})::VARCHAR AS meta FROM ({_ONE}) GROUP BY band"))
def a16(spark, d):
    return band_stats(derived.bands(spark, d), _BANDS).select(F.to_json(F.struct("band", "n_valid", "n_total")).alias("meta"))


@query("A18_materialised", sql("grid", f"SELECT c, {q6('avg(v)')} AS mean, count(*) AS n FROM grid GROUP BY c"))
def a18(spark, d):
    """The grid as a product that is made once for an input: a second run finds it and reads it."""
    kept = made_once(derived.grid(spark, d), f"{run_dir(spark)}/products/grid")
    return kept.groupBy("c").agg(r6(F.avg("v")).alias("mean"), F.count(F.lit(1)).alias("n"))
