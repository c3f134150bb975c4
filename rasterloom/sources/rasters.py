"""Readers and writers of raster products. Parquet is the raster format; a tile column is the layout."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.validity import canonical


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """path, length and modification time of files under root; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", "modificationTime")


def wanted(path: Column, extensions: tuple[str, ...], without: tuple[str, ...] = ()) -> Column:
    """Whether a path has one of the extensions and none of the folders."""
    ok = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)
    for folder in without:
        ok = ok & ~path.contains(f"/{folder}/")
    return ok


#: Substrings of column names and what the columns are called here, in order of trial.
GEOMETRY = (("lat", "lat"), ("lon", "lon"), ("slant", "slant"), ("range", "slant"), ("incidence", "incidence"))


def geometry_names(df: DataFrame) -> DataFrame:
    """Columns of a tie-point table renamed by what their names contain; others keep theirs, stripped."""
    names = []
    for c in df.columns:
        plain = c.strip().lower()
        names.append(next((to for part, to in GEOMETRY if part in plain), c.strip()))
    return df.toDF(*names)


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """A tie-point CSV (one file, or files whose names are in order) with n, the line number from 0, without header lines.

    Files are read in splits. A row's place in its split is counted where it is read, and the lines of each split, a row
    per split, say where the next one begins: no task reads more than its splits."""
    df = geometry_names(spark.read.option("header", True).option("inferSchema", True).csv(path))
    names = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = df.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")).orderBy("_file", "_start").collect()
    begins, n = [], 0
    for r in splits:
        begins.append((r["_file"], r["_start"], n - r["_first"]))
        n += r["_lines"]
    begins = spark.createDataFrame(begins, "_file string, _start long, _shift long")
    return df.join(F.broadcast(begins), ["_file", "_start"]).select(*names, (F.col("_id") + F.col("_shift")).alias("n"))


def write_tiles(df: DataFrame, path: str, tile: int = 256) -> None:
    """Parquet by tile row, so that a window of rows opens only its tiles."""
    df.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int")).write.mode("overwrite").partitionBy("tile_r").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, tile: int = 256) -> DataFrame:
    """Pixels r0..r1 and c0..c1, both ends included: tiles are pruned, rows are filtered in the scan."""
    df = spark.read.parquet(path)
    return df.filter(F.col("tile_r").between(r0 // tile, r1 // tile) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("tile_r")


@dataclass(frozen=True)
class Frame:
    """Where a grid lies: coordinate system, outer corner of the first pixel and pixel size, y falling with rows."""

    crs: str
    left: float
    top: float
    step: float
    nodata: float | None = None


def metadata(df: DataFrame, column: str = "v", frame: Frame | None = None, like: Frame | None = None) -> list[Column]:
    """Catalogue entry of a band, as aggregates; a band without a coordinate system borrows that of its sibling."""
    v, width, height = F.col(column), F.max("c") + 1, F.max("r") + 1
    out = [
        width.alias("width"), height.alias("height"), F.count(F.lit(1)).alias("pixels"), F.count(v).alias("n_valid"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
    ]
    if frame is None:
        return out
    crs = frame.crs or (like.crs if like else None)
    right, bottom = frame.left + width * frame.step, frame.top - height * frame.step
    return [
        *out, F.lit(crs).cast("string").alias("crs"), F.lit(frame.step).alias("res"), F.lit(frame.left).alias("left"), bottom.alias("bottom"),
        right.alias("right"), F.lit(frame.top).alias("top"), F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
        F.lit(frame.nodata).cast("double").alias("nodata"),
    ]


def catalog(bands: dict[str, DataFrame], frames: dict[str, Frame], like: Frame) -> DataFrame:
    """A row of metadata for each band (r, c, v)."""
    rows = [df.agg(*metadata(df, "v", frames[name], like)).select(F.lit(name).alias("band"), "*") for name, df in bands.items()]
    return reduce(DataFrame.unionByName, rows)


def consistent(entries: DataFrame) -> DataFrame:
    """Whether all bands of a catalogue share size, place, resolution and coordinate system."""
    same = F.struct("width", "height", "pixels", "crs", "res", "left", "top")
    return entries.agg((F.count_distinct(same) == 1).alias("same"), (F.count_distinct("width", "height") == 1).alias("same_size"), F.count(F.lit(1)).alias("n_bands"))


def converted(df: DataFrame, column: str, nodata: float) -> DataFrame:
    """A band with its nodata tag turned to NULL by equality (a tolerance of 1e30 would take every pixel)."""
    return df.withColumn(column, canonical(F.col(column), nodata))
