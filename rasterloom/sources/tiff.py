"""Raster files as a Spark data source: strips of 32-bit floats in baseline TIFF, or raw with whatever header.

A raster is one file, or a folder of files for blocks of lines with an index, which the writer's commit step writes last:
what a lost or failed task left behind is in no index and is never read. Reading makes a partition for each run of
strips; a window of rows and columns, given as options or (pushdown=true) by filters on r and c, leaves out the files and
strips that it does not touch, and only those bytes are read.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("path", path).load().filter("r between 60 and 300")

Options: path; pushdown; lines (of a block or a partition); rows and columns (a window, "first,last"); for writing height, width,
nodata, left, top, step; for raw files layout=raw, of a single one height and width too (the header is what stands before
the last height x width values), and kilometres=auto to turn heights into metres in files whose greatest value is under 50. The schema is r, c, v;
nodata and missing pixels are NULL."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Tags of the baseline format, and those that place a grid or name its nodata value.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
#: Field types, as codes of the struct module.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}

INDEX = "_index.json"
MISSING = -9999.0
SCHEMA = "r int, c int, v double"


def place(path: str) -> tuple[object | None, str]:
    """The file system of a path that names one (driver and executors both reach it) and the path in it; None: a mounted one."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    files, at = place(path)
    return os.path.getsize(at) if files is None else files.get_file_info(at).size


def is_file(path: str) -> bool:
    files, at = place(path)
    return os.path.isfile(at) if files is None else files.get_file_info(at).is_file


def read_at(path: str, offset: int, size: int) -> bytes:
    files, at = place(path)
    if files is not None:
        with files.open_input_file(at) as f:
            return f.read_at(size, offset)
    with open(at, "rb") as f:
        f.seek(offset)
        return f.read(size)


def put(path: str, *parts: bytes) -> None:
    """A whole file; its folder is made where there is none."""
    files, at = place(path)
    folder = at.rsplit("/", 1)[0]
    if files is None:
        os.makedirs(folder, exist_ok=True)
    else:
        files.create_dir(folder, recursive=True)
    with open(at, "wb") if files is None else files.open_output_stream(at) as f:
        for part in parts:
            f.write(part)


def remove(path: str) -> None:
    files, at = place(path)
    if files is None:
        os.unlink(at)
    else:
        files.delete_file(at)


def header(width: int, height: int, rows: int, nodata: float, left: float, top: float, step: float) -> bytes:
    """A little-endian TIFF up to its first strip: 32-bit floats, one band, strips of `rows` lines one behind the other."""
    strips = -(-height // rows)
    counts = [4 * width * min(rows, height - k * rows) for k in range(strips)]
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * strips), (SAMPLES, 3, [1]),
        (ROWS, 4, [rows]), (COUNTS, 4, counts), (FORMAT, 3, [3]), (SCALE, 12, [step, step, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, left, top, 0.0]), (NODATA, 2, f"{nodata:g}\0".encode()),
    ]
    packed = lambda kind, v: v if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind]}", *v)
    start = 8 + 2 + 12 * len(fields) + 4
    end = start + sum(len(packed(k, v)) for _, k, v in fields if len(packed(k, v)) > 4)
    at, entries, behind = start, b"", b""
    for tag, kind, values in fields:
        if tag == OFFSETS:
            values = [end + sum(counts[:k]) for k in range(strips)] if strips < 1000 else (end + np.concatenate([[0], np.cumsum(counts)[:-1]])).tolist()
        data = packed(kind, values)
        if len(data) > 4:
            entry, behind, at = struct.pack("<I", at), behind + data, at + len(data)
        else:
            entry = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + entry
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + behind


@dataclass(frozen=True)
class Strips:
    """Where the lines of one file are: (first line, lines, offset) of each strip, in order."""

    path: str
    width: int
    height: int
    order: str
    nodata: float | None
    strips: tuple[tuple[int, int, int], ...]
    scale: float = 1.0


def parsed(path: str) -> Strips:
    """The strips of a TIFF of one band of 32-bit floats without compression, of either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(read_at(path, 0, 2))
    if order is None:
        raise ValueError(f"{path} is no TIFF")
    magic, at = struct.unpack(order + "HI", read_at(path, 2, 6))
    (n,) = struct.unpack(order + "H", read_at(path, at, 2))
    body, tags = read_at(path, at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", body, 12 * k)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize("=" + code) * count
        data = body[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read_at(path, struct.unpack_from(order + "I", body, 12 * k + 8)[0], size)
        tags[tag] = data.rstrip(b"\0").decode() if kind == 2 else struct.unpack(order + code * count, data)
    if magic != 42 or tags.get(COMPRESSION, (1,)) != (1,) or tags.get(BITS) != (32,) or tags.get(FORMAT) != (3,) or tags.get(SAMPLES, (1,)) != (1,):
        raise ValueError(f"{path} is not of 32-bit floats in strips")
    (width,), (height,) = tags[WIDTH], tags[HEIGHT]
    rows = min(tags.get(ROWS, (height,))[0], height)
    nodata = float(tags[NODATA]) if tags.get(NODATA) else None
    return Strips(path, width, height, order, nodata, tuple((k * rows, min(rows, height - k * rows), o) for k, o in enumerate(tags[OFFSETS])))


def raw(path: str, height: int, width: int, lines: int, kilometres: bool) -> Strips:
    """A raw file's values as strips of so many lines. Its greatest value, for the unit, is read a strip at a time."""
    skip = size_of(path) - 4 * height * width
    if skip < 0:
        raise ValueError(f"{path} is too short for {height} x {width} values")
    strips = tuple((k, min(lines, height - k), skip + 4 * width * k) for k in range(0, height, lines))
    scale = 1.0
    if kilometres and strips:
        top = max(np.fmax.reduce(np.frombuffer(read_at(path, o, 4 * width * n), "<f4"), initial=-np.inf) for _, n, o in strips)
        scale = 1000.0 if top < 50 else 1.0
    return Strips(path, width, height, "<", None, strips, scale)


@dataclass
class Run(InputPartition):
    """Strips of one file that lie next to each other, and the number of the file's first line."""

    file: Strips
    strips: tuple[tuple[int, int, int], ...]
    line: int


def _window(text: str | None) -> tuple[float, float]:
    return tuple(map(int, text.split(","))) if text else (-np.inf, np.inf)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.window = {"r": _window(options.get("rows")), "c": _window(options.get("columns"))}

    def files(self) -> Iterator[tuple[Strips, int]]:
        """The files within the window and their first lines; only their headers are read."""
        path = self.options["path"]
        low, high = self.window["r"]
        bare, auto = self.options.get("layout") == "raw", self.options.get("kilometres") == "auto"
        opened = lambda name, height, width: raw(name, height, width, int(self.options.get("lines", 256)), auto) if bare else parsed(name)
        if is_file(path):
            yield opened(path, int(self.options.get("height", 0)), int(self.options.get("width", 0))), 0
        else:
            index = json.loads(read_at(f"{path}/{INDEX}", 0, size_of(f"{path}/{INDEX}")))
            for entry in index["files"]:
                if entry["line"] <= high and entry["line"] + entry["lines"] > low:
                    yield opened(f"{path}/{entry['file']}", entry["lines"], index["width"]), entry["line"]

    def partitions(self) -> list[Run]:
        most, (low, high), out = int(self.options.get("lines", 256)), self.window["r"], []
        for file, line in self.files():
            run: list[tuple[int, int, int]] = []
            for strip in file.strips:
                if line + strip[0] <= high and line + strip[0] + strip[1] > low:
                    if run and sum(n for _, n, _ in run) + strip[1] > most:
                        out.append(Run(file, tuple(run), line))
                        run = []
                    run.append(strip)
            if run:
                out.append(Run(file, tuple(run), line))
        return out or [Run(Strips("", 0, 0, "<", None, ()), (), 0)]  # one part at least

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        (low, high), (left, right) = self.window["r"], self.window["c"]
        width = part.file.width
        columns = np.arange(max(0, int(max(left, 0))), int(min(right, width - 1)) + 1 if right > -np.inf else 0)
        for first, n, offset in part.strips:
            z = np.frombuffer(read_at(part.file.path, offset, 4 * width * n), part.file.order + "f4").reshape(n, width)
            lines = np.arange(n)
            lines = lines[(part.line + first + lines >= low) & (part.line + first + lines <= high)]
            v = z[np.ix_(lines, columns)].astype(np.float64).ravel()
            gone = np.isnan(v) | (v == part.file.nodata if part.file.nodata is not None else False)
            r, c = np.repeat(part.line + first + lines, len(columns)), np.tile(columns, len(lines))
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v * part.file.scale, mask=gone)], ["r", "c", "v"])


class PushingReader(RasterReader):
    """For sessions with spark.sql.python.filterPushdown.enabled, without which Spark refuses a reader that takes filters."""

    def pushFilters(self, filters):
        """Bounds on r and c leave out strips here; Spark goes on to check those on columns row by row."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = type(f).__name__
            if name in self.window and isinstance(getattr(f, "value", None), (int, float)):
                low, high = self.window[name]
                if kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                    low = max(low, f.value)
                if kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
                    high = min(high, f.value)
                self.window[name] = (low, high)
            yield f


@dataclass
class Wrote(WriterCommitMessage):
    files: list


class RasterWriter(DataSourceArrowWriter):
    """Blocks of lines as files. Rows come sorted by r (write() sees to that); a task holds one block at a time."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        o = self.options
        height, width, lines = (int(o[k]) for k in ("height", "width", "lines"))
        nodata, left, top, step = (float(o.get(k, d)) for k, d in (("nodata", MISSING), ("left", 0), ("top", 0), ("step", 1)))
        done, block, z, bare = [], None, None, o.get("layout") == "raw"

        def flush() -> None:
            line, n = block * lines, min(lines, height - block * lines)
            name = f"block-{block:08d}-{uuid.uuid4().hex}" + (".img" if bare else ".tif")
            head = b"PDS3" if bare else header(width, n, min(n, int(o.get("strip", 16))), nodata, left, top - line * step, step)
            put(f"{o['path']}/{name}", head, z[:n].astype("<f4").tobytes())
            done.append({"file": name, "line": line, "lines": n})

        for b in batches:
            r, c = (b.column(k).to_numpy(zero_copy_only=False) for k in ("r", "c"))
            v = b.column("v").to_numpy(zero_copy_only=False)
            v = np.where(np.isnan(v), nodata, v)
            cuts = [0, *(np.flatnonzero(np.diff(r // lines)) + 1), len(r)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if r[i] // lines != block:
                    if block is not None:
                        flush()
                    block, z = int(r[i] // lines), np.full((lines, width), nodata)
                z[r[i:j] - block * lines, c[i:j]] = v[i:j]
        if block is not None:
            flush()
        return Wrote(done)

    def commit(self, messages: list[Wrote | None]) -> None:
        """The index names what was written, once all of it is."""
        entries = sorted((e for m in messages if m for e in m.files), key=lambda e: e["line"])
        index = {"height": int(self.options["height"]), "width": int(self.options["width"]), "files": entries}
        put(f"{self.options['path']}/{INDEX}", json.dumps(index).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        for m in messages:
            for e in m.files if m else ():
                remove(f"{self.options['path']}/{e['file']}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return (PushingReader if self.options.get("pushdown") == "true" else RasterReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options), overwrite)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | str | None = None, columns: tuple[int, int] | str | None = None, **options) -> DataFrame:
    """r, c, v of a raster, or of a window of it (both ends included)."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("raster").option("path", path)
    for name, window in (("rows", rows), ("columns", columns)):
        if window:
            reader = reader.option(name, window if isinstance(window, str) else f"{window[0]},{window[1]}")
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def write_raster(df: DataFrame, path: str, shape: tuple[int, int], lines: int = 256, **options) -> None:
    """r, c, v as a folder of files for `lines` lines each. Lines are dealt to tasks by block, and sorted in them."""
    df.sparkSession.dataSource.register(RasterSource)
    rows = df.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    dealt = rows.repartition(F.floor(F.col("r") / lines)).sortWithinPartitions("r")
    told = options | {"height": shape[0], "width": shape[1], "lines": lines}
    dealt.write.format("raster").options(**{k: str(v) for k, v in told.items()}).mode("append").save(path)
