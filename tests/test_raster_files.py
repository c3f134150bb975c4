"""Raster files, geometry files, and products that are made once."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import resample
from rasterloom.sources import derived, manifest, rasters, tiff

SF = "/root/testdata/sf0.001"


def heights(h, w, seed=1):
    z = np.random.default_rng(seed).normal(size=(h, w)).astype(np.float32).astype(float)
    z[3, 2] = np.nan
    return z


def frame(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "r int, c int, v double").repartition(5)


def arrayed(df, shape):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r["r"], r["c"]] = np.nan if r["v"] is None else r["v"]
    return out


@pytest.mark.parametrize("lines,strip", [(7, 3), (64, 16), (1, 1)])
def test_written_rasters_read_back(spark, tmp_path, lines, strip):
    z, path = heights(40, 9), str(tmp_path / "a")
    tiff.write_raster(frame(spark, z), path, z.shape, lines, strip=strip, left=100, top=500, step=20)
    assert np.array_equal(arrayed(tiff.read_raster(spark, path), z.shape), z, equal_nan=True)
    part = tiff.read_raster(spark, path, (5, 17), (2, 6))
    got = {(r["r"], r["c"]): r["v"] for r in part.collect()}
    assert got == {(r, c): z[r, c] for r in range(5, 18) for c in range(2, 7)}
    index = json.loads((tmp_path / "a" / tiff.INDEX).read_text())
    assert [f["line"] for f in index["files"]] == list(range(0, 40, lines))
    first = tmp_path / "a" / index["files"][0]["file"]
    assert first.read_bytes()[:4] == b"II*\0"
    assert tiff.read_raster(spark, str(first)).count() == min(lines, 40) * 9  # a file by itself


def test_other_blocks_are_not_opened(spark, tmp_path):
    z, path = heights(60, 5), tmp_path / "a"
    tiff.write_raster(frame(spark, z), str(path), z.shape, 10, strip=2)
    for e in json.loads((path / tiff.INDEX).read_text())["files"]:
        if e["line"] not in (20, 30):
            (path / e["file"]).unlink()
    got = tiff.read_raster(spark, str(path), (25, 32))
    assert sorted({r["r"] for r in got.collect()}) == list(range(25, 33))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = tiff.read_raster(spark, str(path), pushdown="true").filter("r >= 25 and r < 33 and c = 2")
        assert {r["r"]: r["v"] for r in pushed.collect()} == {r: z[r, 2] for r in range(25, 33)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="block-0000000"):
        tiff.read_raster(spark, str(path)).count()
    # of a file, only the strips of the window: bytes of others may be anything
    (entry,) = [e for e in json.loads((path / tiff.INDEX).read_text())["files"] if e["line"] == 20]
    reader = tiff.RasterReader({"path": str(path), "rows": "27,27"})
    (run,) = reader.partitions()
    assert run.file.path.endswith(entry["file"]) and run.line == 20 and [s[:2] for s in run.strips] == [(6, 2)]


def test_what_a_failed_write_left_is_not_read(spark, tmp_path):
    z, path = heights(20, 4), str(tmp_path / "a")
    bad = frame(spark, z).withColumn("v", F.when(F.col("r") == 15, F.raise_error(F.lit("no value here")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no value here"):
        tiff.write_raster(bad, path, z.shape, 5)
    assert not (tmp_path / "a" / tiff.INDEX).exists()
    tiff.write_raster(frame(spark, z), path, z.shape, 5)
    assert np.array_equal(arrayed(tiff.read_raster(spark, path), z.shape), z, equal_nan=True)


def test_missing_and_empty(spark, tmp_path):
    z = heights(6, 4)
    tiff.write_raster(frame(spark, z).filter("r <> 4 and c <> 1"), str(tmp_path / "a"), z.shape, 4, nodata=-1)
    got = tiff.read_raster(spark, str(tmp_path / "a")).filter("r = 4 or c = 1 or (r = 3 and c = 2)")
    assert {r["v"] for r in got.collect()} == {None}
    tiff.write_raster(frame(spark, z).limit(0), str(tmp_path / "b"), (0, 4), 4)
    assert tiff.read_raster(spark, str(tmp_path / "b")).count() == 0


def test_big_endian_file_of_another_writer(spark, tmp_path):
    """Tags in another order of bytes, strips in any place, values behind and inside of entries."""
    z = heights(5, 3, 2)
    z[3, 2] = 7.0
    strips = [z[k : k + 2].astype(">f4").tobytes() for k in (0, 2, 4)]
    start = 8 + 2 + 9 * 12 + 4
    at = [start + 24 + 40, start + 24, start + 24 + 64]
    body = bytearray(start + 24 + 100)
    for o, s in zip(at, strips):
        body[o : o + len(s)] = s
    body[start : start + 24] = struct.pack(">3I3I", *at, *map(len, strips))
    entries = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 5, 0)), (258, 3, 1, struct.pack(">HH", 32, 0)), (259, 3, 1, struct.pack(">HH", 1, 0)), (273, 4, 3, struct.pack(">I", start)),
               (278, 3, 1, struct.pack(">HH", 2, 0)), (279, 4, 3, struct.pack(">I", start + 12)), (339, 3, 1, struct.pack(">HH", 3, 0)), (42113, 2, 2, b"7\0\0\0")]
    body[: start - 4] = struct.pack(">2sHIH", b"MM", 42, 8, 9) + b"".join(struct.pack(">HHI", *e[:3]) + e[3] for e in entries)
    (tmp_path / "b.tif").write_bytes(bytes(body))
    z[3, 2] = np.nan
    assert np.array_equal(arrayed(tiff.read_raster(spark, str(tmp_path / "b.tif")), z.shape), z, equal_nan=True)
    (tmp_path / "c.tif").write_bytes(b"GIF89a")
    with pytest.raises(Exception, match="no TIFF"):
        tiff.read_raster(spark, str(tmp_path / "c.tif")).count()


def test_raw_files(spark, tmp_path):
    values = [0.5, 1.25, -2.0, 3.5, 4.0, 5.0]
    (tmp_path / "a.img").write_bytes(b"HEADER" * 3 + struct.pack("<6f", *values))
    read = lambda **o: arrayed(tiff.read_raster(spark, str(tmp_path / "a.img"), layout="raw", height=2, width=3, lines=1, **o), (2, 3))
    assert np.allclose(read(kilometres="auto").ravel(), np.array(values) * 1000) and np.allclose(read().ravel(), values)
    assert rasters.discover(spark, str(tmp_path), "*.img").count() == 1
    with pytest.raises(Exception, match="too short"):
        tiff.read_raster(spark, str(tmp_path / "a.img"), layout="raw", height=20, width=3).count()


def test_geometry_csv(spark, tmp_path):
    lines = ["Latitude (deg),Longitude (deg), Slant_Range (m),Incidence"] + [f"-8{i % 3},{i},{1000 * (i % 3)},{i}" for i in range(9)]
    (tmp_path / "g.csv").write_text("\n".join(lines))
    df = rasters.read_geometry(spark, str(tmp_path / "g.csv"))
    assert df.columns == ["lat", "lon", "slant", "incidence", "n"]
    assert tuple(resample.tie_group(df).first()) == (3, 3, 9)


@pytest.mark.parametrize("limit", ["64", "1000", "128m"])
def test_geometry_lines_are_numbered_over_splits_and_files(spark, tmp_path, limit):
    ties = derived.ties(spark, SF).select("n", F.col("n").cast("double").alias("Slant"), "lat")
    ties.repartitionByRange(5, "n").sortWithinPartitions("n").select("Slant", "lat").write.csv(str(tmp_path / "g"), header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit if limit != "64" else "640")
    try:
        got = rasters.read_geometry(spark, str(tmp_path / "g"))
        assert got.filter(F.col("n") != F.col("slant").cast("long")).count() == 0 and got.count() == ties.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# Products that are made once


def test_products_are_made_once(spark, tmp_path):
    source, path, wrote = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)

    def write(df, at):
        wrote.append(at)
        df.write.parquet(at)

    made = lambda k=2, **o: manifest.made_once(spark.read.parquet(source).select((F.col("id") * k).alias("x")), path, write=write, **o)
    assert sorted(r[0] for r in made().collect()) == list(range(0, 20, 2)) and len(wrote) == 1
    assert made().count() == 10 and len(wrote) == 1  # the second run reads
    assert made(3).agg(F.max("x")).first()[0] == 27 and len(wrote) == 2  # another parameter in the plan
    assert made(3, parameters={"looks": 4}).count() == 10 and len(wrote) == 3  # and beside it
    assert made(3, parameters={"looks": 4}, force=True).count() == 10 and len(wrote) == 4
    spark.range(10, 15).write.mode("append").parquet(source)
    assert made(3, parameters={"looks": 4}).count() == 15 and len(wrote) == 5  # a changed input
    assert made(3, parameters={"looks": 4}).count() == 15 and len(wrote) == 5
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("made-")]) == 1  # older ones are gone


def test_a_broken_run_is_made_again(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(5)

    def fails(table, at):
        table.write.parquet(at)
        raise OSError("full")

    with pytest.raises(OSError):
        manifest.made_once(df, path, write=fails)
    assert manifest.made_once(df, path).count() == 5


def test_a_raster_product_is_made_once(spark, tmp_path):
    z, wrote = heights(12, 5), []
    spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r, c in np.ndindex(z.shape)], "r int, c int, v double").write.parquet(str(tmp_path / "in"))

    def write(df, at):
        wrote.append(at)
        tiff.write_raster(df, at, z.shape, 5)

    for _ in range(2):
        out = manifest.made_once(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), write=write, read=tiff.read_raster)
        assert np.array_equal(arrayed(out, z.shape), z, equal_nan=True)
    assert len(wrote) == 1
