"""Operator 12, media columns: baseline JPEG, and luminance thumbnails from its DC coefficients alone.

Reading: the markers of a baseline stream are parsed (frames of any components and sampling, comments and application
data skipped, fill bytes, restart intervals, several scans), the scans are Huffman-decoded in numpy, and the DC
coefficients of the first component give a thumbnail of one pixel for each 8 x 8 block. What lies between two restart
markers is a lane; all lanes of a batch, of whatever images, are decoded in step, so
that the work is by arrays (a block of each at a time; blocks of a DC code alone take one look-up). Stored are dimensions, the thumbnail and its 64-bit average hash.

Writing: `stored()` keeps bytes as 8-bit samples, a flat 8 x 8 block for each with quantisers of 8, so that a DC
coefficient is the sample less 128 and every decoder gives the samples back exactly: the thumbnail is the payload.
An image is ROW samples wide, each row a restart interval; over MOST_ROWS rows become further frames of the stream.

Defined results: a null or empty text is 192 blanks; repeated rows give repeated rows and equal texts equal values;
a null image gives null columns; one that cannot be read (not JPEG, not baseline, broken off, a code that no table has)
gives nulls and `error`, and others of its batch are not touched; an empty table gives an empty one; columns besides
the key and the text or image are ignored. Texts are whole; long ones are encoded and decoded in pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, sha256_hex, slim, table

ROW = 192
#: 8 * 8191 is the greatest height that a frame can state.
MOST_ROWS = 8191
#: Rows encoded, and bytes of scans decoded, at a time.
PIECE_ROWS = 4096
PIECE_BYTES = 1 << 20

#: Lengths of the codes of the DC categories 0 to 8, and the one AC code (end of block) of the stored form.
DC_LENGTHS = (3, 3, 3, 3, 3, 3, 3, 4, 5)
END_LENGTHS = (1,)


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: tuple[int, ...]) -> bytes:
    return _segment(0xC4, bytes([kind, *(lengths.count(n) for n in range(1, 17)), *range(len(lengths))]))


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for the differences -255 to 255, with the end-of-block code (a 0) after them."""
    bits, sizes, code, codes = [], [], 0, []
    for k, n in enumerate(DC_LENGTHS):  # canonical: counted up, longer codes shifted on
        codes.append(code := (code << (n - DC_LENGTHS[k - 1])) if k else 0)
        code += 1
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << size) - 1
        bits.append((codes[size] << size | extra) << 1)
        sizes.append(DC_LENGTHS[size] + size + 1)
    return np.array(bits, np.int64), np.array(sizes, np.int64)


_BITS, _SIZES = _difference_codes()
_BEFORE = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x08" * 64)
_AFTER = _table(0x00, DC_LENGTHS) + _table(0x10, END_LENGTHS) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def _lanes(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded segment of each row of samples, filled up with ones and with bytes stuffed."""
    d = np.diff(samples.astype(np.int16) - 128, axis=1, prepend=0) + 255
    bits, sizes = _BITS[d], _SIZES[d]
    bits, sizes = bits[:, ::2] << sizes[:, 1::2] | bits[:, 1::2], sizes[:, ::2] + sizes[:, 1::2]  # two codes, 28 bits at most
    upto = np.cumsum(sizes, axis=1)
    fill = -upto[:, -1] % 8
    ends = np.cumsum((upto[:, -1] + fill) // 8)
    at = (upto - sizes + 8 * np.concatenate([[0], ends[:-1]])[:, None]).ravel()
    bits = bits.ravel() << (64 - (at & 31) - sizes.ravel())
    at >>= 5
    n = int(ends[-1]) // 4 + 2
    # codes share no bit, so that sums of their words are what the words hold
    words = np.bincount(at, (bits >> 32) & 0xFFFFFFFF, n) + np.bincount(at + 1, bits & 0xFFFFFFFF, n + 1)[:n]
    out = words.astype(">u4").view(np.uint8)[: ends[-1]]
    out[ends - 1] |= ((1 << fill) - 1).astype(np.uint8)
    full = (out == 255).nonzero()[0]
    data = np.insert(out, full + 1, 0).tobytes()
    ends = (ends + np.searchsorted(full, ends)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _frame(lanes: list[bytes]) -> bytes:
    size = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * len(lanes), 8 * ROW, 1, 1, 0x11, 0))
    marked = [part for k, lane in enumerate(lanes) for part in (lane, _RESTARTS[k % 8])]
    return b"".join([_BEFORE, size, _AFTER, *marked[:-1], b"\xff\xd9"])


def stored(payloads: list[bytes]) -> list[bytes]:
    """A stream of frames for each payload of whole rows."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    lanes = [x for k in range(0, len(rows), PIECE_ROWS) for x in _lanes(rows[k : k + PIECE_ROWS])]
    out, at = [], 0
    for p in payloads:
        n = len(p) // ROW
        out.append(b"".join(_frame(lanes[at + k : at + min(n, k + MOST_ROWS)]) for k in range(0, n, MOST_ROWS)))
        at += n
    return out


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW if data else ROW)


# Reading


class Unreadable(ValueError):
    """An image that is no readable baseline JPEG."""


class Lane(NamedTuple):
    """What lies between two restart markers: bytes, units, and for each block of a unit its tables and whether it is
    the first component's."""

    data: bytes
    units: int
    blocks: tuple[tuple[bytes, bytes, bool], ...]


class Frame(NamedTuple):
    width: int
    height: int
    components: int
    #: Blocks across and down of the first component, and its blocks in a unit, across and down.
    grid: tuple[int, int]
    unit: tuple[int, int]
    quantiser: int
    lanes: list[Lane]


_MARK = re.compile(rb"\xff+[^\x00\xff]", re.S)


def _parts(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The segments of a scan that begins at a place, and the place of the marker after it."""
    parts, start = [], at
    for m in _MARK.finditer(data, at):
        parts.append(data[start : m.start()].replace(b"\xff\0", b"\xff"))
        if not 0xD0 <= data[m.end() - 1] <= 0xD7:
            return parts, m.end() - 2
        start = m.end()
    raise Unreadable("a scan breaks off")


def frames(data: bytes) -> list[Frame]:
    """The frames of a stream of baseline JPEG images."""
    try:
        out, at = [], 0
        while at < len(data):
            frame, at = _parsed(data, at)
            out.append(frame)
    except (IndexError, struct.error) as e:
        raise Unreadable("the markers break off") from e
    if not out:
        raise Unreadable("no image")
    return out


def _parsed(data: bytes, at: int) -> tuple[Frame, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise Unreadable("no start of image")
    at += 2
    quantisers, tables, size, comps, every, lanes, plan = {}, {}, None, {}, 0, [], None
    while True:
        if data[at] != 0xFF:
            raise Unreadable("no marker where one must be")
        while data[at + 1] == 0xFF:
            at += 1
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + length], at + length
        if len(body) != length - 2:
            raise Unreadable("the markers break off")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            comps = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if bits != 8 or not width or not height or not comps or any(not (0 < h < 5 and 0 < v < 5) for h, v, _ in comps.values()):
                raise Unreadable("no 8-bit frame with a size")
            size = (width, height)
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise Unreadable("not baseline")
        elif marker == 0xDA:
            if size is None:
                raise Unreadable("a scan without a frame")
            parts, at = _parts(data, at)
            got, shape = _scan(body, size, comps, tables, every, parts)
            lanes += got
            plan = plan or shape
    if plan is None:
        raise Unreadable("no scan of the first component")
    first = next(iter(comps.values()))
    if first[2] not in quantisers:
        raise Unreadable("no quantisers")
    return Frame(*size, len(comps), *plan, quantisers[first[2]], lanes), at


def _scan(body: bytes, size, comps, tables, every, parts) -> tuple[list[Lane], tuple | None]:
    first = next(iter(comps))
    chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
    most = max(h for h, _, _ in comps.values()), max(v for _, v, _ in comps.values())
    if any(c not in comps for c, _ in chosen) or any(t not in tables for _, k in chosen for t in (k >> 4, 0x10 | k & 15)):
        raise Unreadable("a scan names what is not there")
    ceil = lambda a, b: -(-a // b)
    blocks, shape, whole = [], None, len(chosen) == 1
    for c, k in chosen:
        h, v, _ = comps[c]
        unit = (1, 1) if whole else (h, v)
        blocks += [(tables[k >> 4], tables[0x10 | k & 15], c == first)] * (unit[0] * unit[1])
        if c == first:
            shape = unit
    if whole:
        h, v, _ = comps[chosen[0][0]]
        across, down = (ceil(ceil(s * f, m), 8) for s, f, m in zip(size, (h, v), most))
    else:
        across, down = (ceil(s, 8 * m) for s, m in zip(size, most))
    units, every = across * down, every or across * down
    if len(parts) != ceil(units, every):
        raise Unreadable("restart intervals are missing")
    lanes = [Lane(p, min(every, units - k * every), tuple(blocks)) for k, p in enumerate(parts)]
    return lanes, shape and ((across * shape[0], down * shape[1]), shape)


@lru_cache(maxsize=64)
def _lookup(spec: bytes) -> np.ndarray:
    """Length and symbol of the code that each 16 bits begin with, as length * 256 + symbol; 0 where none does."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            if code >= 1 << n:
                raise Unreadable("a table has too many codes")
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def coefficients(lanes: list[Lane]) -> list[np.ndarray | None]:
    """The quantised DC coefficients of the first component's blocks in each lane; None where a lane can't be read."""
    out: list[np.ndarray | None] = [None] * len(lanes)
    alike = defaultdict(list)
    for k, lane in enumerate(lanes):
        alike[lane.blocks].append(k)
    for blocks, members in alike.items():
        now, size = [], 0
        for k in members:
            now.append(k)
            size += len(lanes[k].data)
            if size >= PIECE_BYTES or k == members[-1]:
                try:
                    for j, got in zip(now, _in_step([lanes[i] for i in now], blocks)):
                        out[j] = got
                except Unreadable:
                    pass  # the tables themselves: none of these lanes can be read
                now, size = [], 0
    return out


@lru_cache(maxsize=64)
def _whole_block(dc: bytes, ac: bytes) -> np.ndarray:
    """For each 16 bits that begin with a whole block of a DC coefficient alone: its difference * 32 + its bits; else 0."""
    w = np.arange(1 << 16)
    code = _lookup(dc)
    size = code & 255
    used = (code >> 8) + size
    end = _lookup(ac)[(w << np.minimum(used, 16)) & 0xFFFF]
    ok = (code > 0) & (used <= 16) & (end > 0) & (end & 255 == 0) & (used + (end >> 8) <= 16)
    size, used = np.where(ok, size, 0), np.where(ok, used, 0)
    return np.where(ok, _signed((w >> (16 - used)) & ((1 << size) - 1), size) * 32 + used + (end >> 8), 0)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number that so many further bits stand for."""
    return np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)


def _in_step(lanes: list[Lane], blocks) -> list[np.ndarray | None]:
    """Lanes with the same tables, one block of each at a time."""
    per_unit = sum(wanted for _, _, wanted in blocks)
    starts = np.cumsum([0, *(len(lane.data) for lane in lanes)])
    data = np.frombuffer(b"".join([*(lane.data for lane in lanes), b"\0" * 16]), np.uint8)
    words = np.zeros(len(data) - 8, np.uint64)  # the 64 bits from each byte on
    for k in range(8):
        words |= data[k : len(data) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    short = (words >> np.uint64(32)).astype(np.int64)
    first_out = np.cumsum([0, *(lane.units * per_unit for lane in lanes)])
    found, good = np.zeros(first_out[-1], np.int64), np.ones(len(lanes), bool)
    units = np.array([lane.units for lane in lanes])
    #: Of the lanes still at work: number, bit, end, and place in found.
    lane, bit, end, to = np.arange(len(lanes)), 8 * starts[:-1], 8 * starts[1:], first_out[:-1].copy()
    done, next_end = 0, int(units.min())
    while len(lane):
        for dc, ac, wanted in blocks:
            whole = _whole_block(dc, ac)[short[bit >> 3] >> (16 - (bit & 7)) & 0xFFFF]
            difference, bad = whole >> 5, None
            if not whole.all():
                rest = (whole == 0).nonzero()[0]
                difference[rest], used, broken = _block(words, bit[rest], end[rest], _lookup(dc), _lookup(ac))
                whole[rest] = used  # as difference is set, only the bits count
                bit = bit + np.where(np.isin(np.arange(len(lane)), rest), whole, whole & 31)
                if broken.any():
                    bad = rest[broken]
            else:
                bit = bit + (whole & 31)
            if wanted:
                found[to] = difference
                to = to + 1
            if bad is not None or (bit > end).any():
                keep = bit <= end
                if bad is not None:
                    keep[bad] = False
                good[lane[~keep]] = False
                lane, bit, end, to = lane[keep], bit[keep], end[keep], to[keep]
        done += 1
        if done == next_end and len(lane):
            keep = units[lane] > done
            lane, bit, end, to = lane[keep], bit[keep], end[keep], to[keep]
            next_end = int(units[lane].min()) if len(lane) else 0
    upto = np.concatenate([[0], np.cumsum(found)])
    upto[1:] -= np.repeat(upto[first_out[:-1]], np.diff(first_out))  # from the lane's begin on
    return [upto[a + 1 : b + 1] if ok else None for a, b, ok in zip(first_out.tolist(), first_out[1:].tolist(), good.tolist())]


def _block(words: np.ndarray, start: np.ndarray, end: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Difference, bits, and whether something is wrong, of a block of any coefficients in each lane."""

    def code(table: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[(word >> np.uint64(48)).astype(np.int64)]
        return found >> 8, found & 255

    def word(bit: np.ndarray) -> np.ndarray:
        return words[bit >> 3] << (bit & 7).astype(np.uint64)

    now = word(start)
    length, size = code(dc, now)
    broken = (length == 0) | (size > 11)
    size = np.where(broken, 0, size)
    extra = ((now << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    bit, at = start + length + size, np.ones(len(start), np.int64)
    open_ = (~broken & (bit <= end)).nonzero()[0]
    while len(open_):  # lanes whose block has further codes
        length, symbol = code(ac, word(bit[open_]))
        run, more = symbol >> 4, symbol & 15
        bit[open_] += length + more
        at[open_] = np.where(symbol == 0, 64, at[open_] + run + 1)
        wrong = (length == 0) | ((more == 0) & (run > 0) & (run < 15)) | (at[open_] > 64) | (bit[open_] > end[open_])
        broken[open_[wrong]] = True
        open_ = open_[~wrong & (at[open_] < 64)]
    return _signed(extra, size), bit - start, broken


def _thumbnail(frame: Frame, dc: list[np.ndarray]) -> np.ndarray:
    (across, down), (h, v) = frame.grid, frame.unit
    flat = np.concatenate(dc) * frame.quantiser
    light = np.clip((flat + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    grid = light.reshape(down // v, across // h, v, h).transpose(0, 2, 1, 3).reshape(down, across)
    return grid[: -(-frame.height // 8), : -(-frame.width // 8)]


@lru_cache(maxsize=4096)
def _eighths(shape: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Where 8 parts begin in each direction (one pixel may be several), and the pixels of each of the 64."""
    cuts = [np.arange(8) * n // 8 for n in shape]
    sizes = [np.maximum(np.diff(c, append=n), 1) for c, n in zip(cuts, shape)]
    return cuts, sizes[0][:, None] * sizes[1]


def average_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which of 8 x 8 parts of a thumbnail are lighter than all of it."""
    (a, c), area = _eighths(thumbnail.shape)
    part = np.add.reduceat(np.add.reduceat(thumbnail, a, axis=0, dtype=np.int64), c, axis=1)
    light = part * thumbnail.size > part.dtype.type(thumbnail.sum(dtype=np.int64)) * area
    return int.from_bytes(np.packbits(light).tobytes(), "big")


class Picture(NamedTuple):
    """What is kept of an image: the size of its frames, one below the other, and their thumbnails."""

    width: int
    height: int
    frames: int
    components: int
    thumbnail: np.ndarray


def pictures(images: list[bytes | None]) -> list[Picture | str | None]:
    """A picture for each image, or what is wrong with it."""
    parsed: list = []
    for data in images:
        try:
            parsed.append(None if data is None else frames(data))
        except Unreadable as e:
            parsed.append(str(e))
    flat = [(k, f) for k, fs in enumerate(parsed) if isinstance(fs, list) for f in fs]
    decoded = iter(coefficients([lane for _, f in flat for lane in f.lanes]))
    thumbnails = defaultdict(list)
    for k, f in flat:
        every = [next(decoded) for _ in f.lanes]
        ours = [dc for dc, lane in zip(every, f.lanes) if any(b[2] for b in lane.blocks)]
        broken = any(dc is None for dc in every) or sum(len(dc) for dc in ours) != f.grid[0] * f.grid[1]
        thumbnails[k].append(None if broken else _thumbnail(f, ours))
    out: list[Picture | str | None] = []
    for k, fs in enumerate(parsed):
        if not isinstance(fs, list):
            out.append(fs)
        elif any(t is None for t in thumbnails[k]):
            out.append("a scan can't be decoded")
        elif len({t.shape[1] for t in thumbnails[k]}) > 1:
            out.append("frames differ in width")
        else:
            out.append(Picture(fs[0].width, sum(f.height for f in fs), len(fs), fs[0].components, np.concatenate(thumbnails[k])))
    return out


def feature(p: Picture) -> str:
    """Size, frames and thumbnail hash."""
    return f"{p.width}x{p.height}/{p.frames}:{average_hash(p.thumbnail):016x}"


# Tables


def _mapped(df: DataFrame, rows, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """df's first column, and what rows() gives for the batch's others, a list of tuples."""
    bounded_batches(df.sparkSession)
    key = df.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(",")]
        for b in batches:
            if b.num_rows:
                columns = zip(*rows(*(c.to_pylist() for c in b.columns[1:])))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], [key, *names])

    return df.mapInArrow(slim(run), f"`{key}` {df.schema[0].dataType.simpleString()}, {schema}")


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the text as a media column: a JPEG stream whose samples are its bytes."""

    def rows(texts):
        data = [(t or "").encode() for t in texts]
        return list(zip(map(len, data), stored([padded(d) for d in data])))

    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("t")), rows, "n_bytes long, media binary", [pa.int64(), pa.binary()])


def thumbnails(df: DataFrame, key: str, media: str) -> DataFrame:
    """key, width, height, components, thumbnail (a byte a pixel), its hash, and error, for a column of JPEG images."""

    def rows(images):
        out = []
        for p in pictures(images):
            if isinstance(p, Picture):
                out.append((p.width, p.height, p.components, p.thumbnail.tobytes(), f"{average_hash(p.thumbnail):016x}", None))
            else:
                out.append((None,) * 5 + (p,))
        return out

    kinds = [pa.int32()] * 3 + [pa.binary(), pa.string(), pa.string()]
    narrow = df.select(F.col(f"`{key}`"), F.col(f"`{media}`").alias("media"))
    return _mapped(narrow, rows, "width int, height int, components int, thumbnail binary, thumbnail_hash string, error string", kinds)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what is read back: the thumbnail of a stored text is its payload."""

    def rows(sizes, images):
        out = []
        for n, data, p in zip(sizes, images, pictures(images)):
            if not isinstance(p, Picture):
                raise Unreadable(p)
            payload = p.thumbnail.tobytes()
            out.append((n, len(payload), sha256_hex(payload), zlib.crc32(payload[-16:]), len(data), sha256_hex(data), feature(p)))
        return out

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _mapped(with_media(table(spark, sf_dir, "documents")), rows, schema, kinds)
