"""Operator 2, suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Method: hash-compared suffix sort (suffix_sort.py). Sorting every suffix of a corpus in one place is out of
the question, so suffixes first find the few others they could equal. Every 100-byte window has an anchor, the
GRAM-byte piece in it with the smallest hash, the leftmost on a tie; that depends on the window's bytes alone,
so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a segment.
Segments are shuffled by the hash of their anchor: one that is alone there holds nothing that repeats. The
bytes of the others are fetched and compared anchor by anchor: equal segments lose all but the first, and the
windows of different segments are suffix-sorted, with equal neighbours verified. Hashes only say what is to be
compared; whatever is removed was found equal byte by byte.

Hot anchors. Copies inside one Arrow batch are settled there (byte by byte too), so that a hot string sends one
row per batch. Anchors that a sample of the documents shows to be hot are dealt to SALTS groups each; what is
left of those groups meets in a second round. Anchors with many different segments are also split into single
windows, each with its own hash as key. The sample (1 document in SAMPLE, at most HINTS anchors, 8 bytes each)
is a hint: it changes how work is dealt and no result.

Order of places is (doc_id, start), a null doc_id last. Defined results: a null text is empty; texts under 100
bytes lose nothing; rows of one doc_id (or none) start at the same places, so that none loses a byte to the
same start of another; rows are told apart by doc_id and 128 bits of text hash, so that only rows with one text
share what is removed; an empty table gives an empty one; other columns stay as they are. Very long texts are
cut into overlapping pieces of PIECE bytes for hashing only. Memory of a task: one Arrow batch and its hashes,
or the segments of CHUNK rows and one group's.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, discard, plain_names, sha256_hex, slim, table, written
from rasterloom.llm.suffix_sort import SECOND, Hashes, suffix_order

LENGTH = 100
GRAM = 32
PIECE = 1 << 18
CHUNK = 4_000
NO_ID = (1 << 63) - 1
SAMPLE = 64
#: Rows (or different segments) of an anchor in the sample from which it is hot.
HOT = 16
HINTS = 1_000_000
SALTS = 64
#: The bytes of segments are fetched by parts of the anchors, so that not all of them lie on disk at once.
PASSES = 2
#: s of a row: a group number of a hot anchor from 1 on, else ALONE; KNOWN rows are removals found in a batch.
ALONE, KNOWN = 0, -1
_ROW = "h long, s int, g long, d long, p long, a long, b long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in some (sorted)."""
    if not len(some):
        return np.zeros(len(x), bool)
    at = np.searchsorted(some, x)
    at[at == len(some)] = 0
    return some[at] == x


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of count places from first on: the run of each place, and the place."""
    run = np.repeat(np.arange(len(count)), count)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def segments(data: np.ndarray, bounds: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows that lie inside [bounds[i], bounds[i+1]): for each run of windows with one anchor its
    first start, its number of windows, the anchor's offset from there, anchor hash, segment hash and whether it was
    split. Runs of crowded anchors are split into windows, whose own hash takes the place of the anchor's."""
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)), np.zeros(0, bool))
    if len(data) < LENGTH:
        return none
    hashes = Hashes(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = mixed(hashes.of(places, GRAM))
    key = (grams & ~np.uint64(0xFFFFFF)) | places.astype(np.uint64)  # ties go to the leftmost
    low, wide, most = key, 1, LENGTH - GRAM + 1
    while 2 * wide <= most:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < most:
        low = np.minimum(low[: len(low) - (most - wide)], low[most - wide :])
    sizes = np.diff(bounds)
    inside = np.ones(len(data) + 1, bool)
    ends = np.repeat(bounds[1:], np.minimum(sizes, LENGTH - 1))
    tail = np.concatenate([np.arange(max(a, b - LENGTH + 1), b) for a, b in zip(bounds[:-1], bounds[1:])]) if len(ends) else np.zeros(0, np.int64)
    inside[tail] = False
    starts = np.flatnonzero(inside[: len(low)])
    if not len(starts):
        return none
    anchor = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(starts)])
    start, offset, h = starts[first], anchor[first] - starts[first], grams[anchor[first]]
    split = among(h, crowded)
    if split.any():
        _, single = spread(start[split], count[split])
        own = mixed(Hashes(data, SECOND).of(single, np.full(len(single), LENGTH)))
        one, keep = np.ones(len(single), np.int64), ~split
        start, count, offset, h = (np.concatenate(x) for x in zip((start[keep], count[keep], offset[keep], h[keep]), (single, one, 0 * one, own)))
        split = np.r_[np.zeros(keep.sum(), bool), np.ones(len(single), bool)]
    return start, count, offset, h, mixed(hashes.of(start, count + (LENGTH - 1))), split


def settle(texts: list[bytes], ids: np.ndarray, marks: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, ...], hot: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch: segments that no earlier row of the batch has, and KNOWN runs that repeat one."""
    row, p, count, offset, h, g, split = found
    shape = (g >> np.uint64(48)).astype(np.int64) << 14 | count << 7 | offset
    d, a, b = ids[row], marks[0][row], marks[1][row]
    order = np.lexsort((b, a, p, d, g, h))
    row, p, count, h, g, shape, split, d, a, b = (x[order] for x in (row, p, count, h, g, shape, split, d, a, b))
    head = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    of = np.flatnonzero(head)[np.cumsum(head) - 1]
    later, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[1:] = ~head[1:] & (d[1:] == d[:-1]) & (p[1:] == p[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # one row, twice
    copy = np.flatnonzero(~again & ((d > d[of]) | ((d == d[of]) & (p > p[of]))))
    n = count[copy] + LENGTH - 1
    both = (row[copy], p[copy], p[copy] + n, row[of[copy]], p[of[copy]], p[of[copy]] + n)
    later[copy] = [texts[i][x:y] == texts[j][u:v] for i, x, y, j, u, v in zip(*(x.tolist() for x in both))]
    at = np.flatnonzero(later)
    at = at[np.lexsort((p[at], row[at]))]
    fresh = np.flatnonzero(np.r_[True, (row[at][1:] != row[at][:-1]) | (p[at][1:] > p[at][:-1] + count[at][:-1])]) if len(at) else at
    length = np.maximum.reduceat(p[at] + count[at], fresh) - p[at][fresh] if len(at) else at
    at = at[fresh] if len(at) else at
    keep = ~later & ~again
    kh = mixed(d[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a[at].view(np.uint64) + p[at].view(np.uint64)).view(np.int64)
    salt = (mixed(d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ a.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
    s = np.where(split | among(h, hot), salt, ALONE).astype(np.int32)
    known = (kh, np.full(len(at), KNOWN, np.int32), length, d[at], p[at], a[at], b[at])
    columns = [pa.array(np.concatenate([x[keep], y])) for x, y in zip((h.view(np.int64), s, shape, d, p, a, b), known)]
    return pa.RecordBatch.from_arrays(columns, ["h", "s", "g", "d", "p", "a", "b"])


def identity() -> list[Column]:
    """d, a and b: the place of a row in the order, and 128 bits of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")]


def anchors(docs: DataFrame, hints: Broadcast | None = None) -> DataFrame:
    """A row per segment: h (anchor), s (group), g (16 bits of segment hash, windows, offset), d, p (start), a and b;
    for KNOWN rows g is the number of windows from p on that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, crowded = hints.value if hints else (np.zeros(0, np.uint64),) * 2
        for x in batches:
            ids, *marks = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = [(t or "").encode() for t in x.column(3).to_pylist()]
            found: list[tuple] = []
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush() -> None:
                if not held:
                    return
                bounds = np.concatenate(([0], np.cumsum([len(x) for _, _, x in held])))
                start, *rest = segments(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), bounds, crowded)
                of = np.searchsorted(bounds, start, side="right") - 1
                rows, at = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
                found.append((rows[of], start - bounds[of] + at[of], *rest))
                held.clear()

            for i, data in enumerate(texts):
                for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
                    part = data[at : at + PIECE + LENGTH - 1]
                    held.append((i, at, part))
                    size += len(part)
                    if size >= PIECE:
                        flush()
                        size = 0
            flush()
            if found:
                yield settle(texts, ids, tuple(marks), tuple(np.concatenate(x) for x in zip(*found)), hot)

    return docs.select(*identity(), F.col("text").cast("string").alias("text")).mapInArrow(slim(run), _ROW)


def hot_anchors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors that a sample shows to be hot, and of those among them with many different segments."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    counted = anchors(sample).filter(F.col("s") == ALONE).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("kinds"))
    rows = counted.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(HINTS).select("h", (F.col("kinds") >= HOT).alias("crowd")).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    crowd = rows["crowd"].to_numpy(bool)
    return np.sort(h), np.sort(h[crowd])


def grouped(rows: DataFrame) -> DataFrame:
    """The rows, each once, but those that are alone with their anchor; many: not alone in their group."""
    place = ["d", "p", "a", "b", "g"]
    group = Window.partitionBy("h", "s").orderBy(*place)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differ = lambda x, y: functools.reduce(operator.or_, [F.coalesce(x(c) != y(c), F.lit(True)) for c in place])
    out = rows.select(
        "*", differ(lambda c: F.first(c).over(whole), lambda c: F.last(c).over(whole)).alias("many"),
        differ(F.col, lambda c: F.lag(c).over(group)).alias("fresh"),
    )
    return out.filter(F.col("fresh") & ((F.col("s") != ALONE) | F.col("many"))).drop("fresh")


def shared_anchors(rows: DataFrame, hot: bool) -> DataFrame:
    """The rows to compare: those that are not alone with their anchor. The groups of hot anchors are counted by
    aggregation, and the count joined back (from a written table, so that AQE can split a hot anchor)."""
    out = rows.filter((F.col("s") == ALONE) & F.col("many")).drop("many")
    if not hot:
        return out
    dealt = rows.filter(F.col("s") > ALONE).drop("many")
    several = written(rows.sparkSession, dealt.groupBy("h").count().filter("count > 1").select("h"), "several")
    return out.union(dealt.join(several, "h").select(*out.columns))


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the bytes of each segment. Documents are one per identity, pre-aggregated before they are shuffled."""
    wanted = rows.groupBy("d", "a", "b").agg(F.collect_list(F.struct("h", "s", "g", "p")).alias("w"))
    text = F.col("text").cast("string")
    keyed = docs.filter(F.octet_length(text) >= LENGTH).select(*identity(), text.alias("text")).dropDuplicates(["d", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sizes = pc.list_value_length(x.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            w = x.column(4).flatten()
            h, s, g, p = (w.field(i) for i in range(4))
            of = np.repeat(np.arange(len(sizes)), sizes)
            n = (g.to_numpy() >> 7 & 127) + (LENGTH - 1)
            texts = [t.encode() for t in x.column(3).to_pylist()]
            segs = [texts[i][q : q + k] for i, q, k in zip(of.tolist(), p.to_pylist(), n.tolist())]
            d, a, b = (x.column(i).take(pa.array(of)) for i in range(3))
            yield pa.RecordBatch.from_arrays([h, s, g, d, p, a, b, pa.array(segs, pa.binary())], ["h", "s", "g", "d", "p", "a", "b", "seg"])

    joined = keyed.join(wanted, ["d", "a", "b"]).select("d", "a", "b", "text", "w")
    return joined.mapInArrow(slim(run), f"{_ROW}, seg binary")


def window_repeats(group, g, d, p, segs) -> tuple[np.ndarray, np.ndarray]:
    """Row and step of each window that equals an earlier one of its group."""
    data = np.frombuffer(b"".join(segs), np.uint8)
    size, count = np.array([len(x) for x in segs], np.int64), g >> 7 & 127
    row, step = spread(np.zeros(len(segs), np.int64), count)
    place, start = (np.cumsum(size) - size)[row] + step, p[row] + step
    cls = group[row] * 256 + 128 + (g & 127)[row] - step
    # a window whose hash no other of its class has needs no place in the order
    whole = Hashes(data).of(place, LENGTH)
    by = np.lexsort((whole, cls))
    near = (cls[by][1:] == cls[by][:-1]) & (whole[by][1:] == whole[by][:-1])
    some = by[np.r_[near, False] | np.r_[False, near]]
    some = some[np.lexsort((start[some], d[row[some]]))]  # ties keep the order of places
    order, same = suffix_order(data, place[some], cls[some], LENGTH)
    order = some[order]
    first = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]] if len(order) else order
    dd, d0 = d[row[order]], d[row[first]]
    hit = order[(dd > d0) | ((dd == d0) & (start[order] > start[first]))]
    return row[hit], step[hit]


def group_repeats(h, s, g, d, p, segs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of (h, s, d, p): row, step and number of the windows that equal an earlier one of their
    (h, s), and the rows that are no copies of an earlier row."""
    group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]) - 1
    first: dict[tuple[int, bytes], int] = {}
    of = np.array([first.setdefault((k, x), i) for i, (k, x) in enumerate(zip(group.tolist(), segs))])
    whole = (d > d[of]) | (p > p[of])  # rows come in the order of places
    own = np.flatnonzero(~whole)
    kinds = np.bincount(group[np.array(list(first.values()), np.int64)], minlength=group[-1] + 1)
    sort = own[kinds[group[own]] > 1]  # the windows of one segment differ in their offset
    copies = np.flatnonzero(whole)
    row, step, n = copies, np.zeros(len(copies), np.int64), g[copies] >> 7 & 127
    if len(sort):
        r, t = window_repeats(group[sort], g[sort], d[sort], p[sort], [segs[i] for i in sort])
        by = np.lexsort((t, r))
        r, t = r[by], t[by]
        fresh = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1] + 1)]) if len(r) else r
        length = np.diff(np.r_[fresh, len(r)]) if len(r) else r
        row, step, n = (np.concatenate(x) for x in ((row, sort[r[fresh]]), (step, t[fresh]), (n, length)))
    return row, step, n, own


def compared(texts: DataFrame, again: bool) -> DataFrame:
    """The rows of texts by groups (h, s): runs of g windows from p on that equal an earlier window, as KNOWN rows;
    and, if again, what is left of the groups of hot anchors, with its bytes."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        *numbers, segs = zip(*rows)
        h, s, g, d, p, a, b = (np.array(x, np.int64) for x in numbers)
        row, step, n, own = group_repeats(h, s, g, d, p, segs)
        own = own[s[own] > ALONE] if again else own[:0]
        lost = (h[row], np.full(len(row), KNOWN), n, d[row], p[row] + step, a[row], b[row])
        columns = [np.concatenate([x, y[own]]) for x, y in zip(lost, (h, s, g, d, p, a, b))]
        arrays = [pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(columns)]
        bytes_of = pa.array([None] * len(row) + [segs[i] for i in own], pa.binary())
        return pa.RecordBatch.from_arrays([*arrays, bytes_of], ["h", "s", "g", "d", "p", "a", "b", "seg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for x in batches:
            rows += zip(*(c.to_pylist() for c in x.columns))
            if len(rows) >= CHUNK:
                cut = len(rows)
                while cut and rows[cut - 1][:2] == rows[-1][:2]:
                    cut -= 1
                if cut:
                    yield solve(rows[:cut])
                    rows = rows[cut:]
        if rows:
            yield solve(rows)

    return texts.repartition("h", "s").sortWithinPartitions("h", "s", "d", "p").mapInArrow(slim(run), f"{_ROW}, seg binary")


def spans(docs: DataFrame) -> DataFrame:
    """d, a, b and s, the array of (start, windows) whose bytes are to go, for each document that has some."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hints = hot_anchors(docs)
    rows = anchors(docs, spark.sparkContext.broadcast(hints))
    rows = written(spark, grouped(rows), "segments")
    hot = len(hints[0]) > 0
    together = shared_anchors(rows, hot)
    passes = [together.filter(F.pmod("h", F.lit(PASSES)) == k) for k in range(PASSES)]
    found = [written(spark, compared(texts_of(docs, part), hot), "found") for part in passes]
    every = functools.reduce(DataFrame.union, found)
    lost = rows.filter(F.col("s") == KNOWN).drop("many").union(every.filter(F.col("s") == KNOWN).drop("seg"))
    if hot:
        lost = lost.union(compared(every.filter(F.col("s") > ALONE).withColumn("s", F.lit(ALONE)), False).drop("seg"))
    part = F.struct(F.col("p"), F.col("g").alias("n"))
    out = written(spark, lost.groupBy("d", "a", "b").agg(F.collect_list(part).alias("s")), "spans")
    discard(rows, *found)
    return out


def kept_bytes(data: bytes, found: list | None) -> tuple[bytes, int, int]:
    """The remaining bytes, how many went and in how many maximal runs."""
    if not found:
        return data, 0, 0
    edges = np.zeros(len(data) + 1, np.int32)
    p = np.array([s["p"] for s in found])
    np.add.at(edges, p, 1)
    np.add.at(edges, p + np.array([s["n"] for s in found]) + (LENGTH - 1), -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of docs with _s, the windows to go (null: none)."""
    found = spans(docs).toDF("_d", "_a", "_b", "_s")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(identity(), ("_kd", "_ka", "_kb"))])
    same = (F.col("_kd") == F.col("_d")) & (F.col("_ka") == F.col("_a")) & (F.col("_kb") == F.col("_b"))
    return keyed.join(found, same, "left").drop("_kd", "_ka", "_kb", "_d", "_a", "_b")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (text or "").encode()
                kept, gone, runs = kept_bytes(data, found)
                rows.append((len(data), gone, runs, sha256_hex(kept)))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(slim(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))


@plain_names
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated bytes. What is left of a character that lost a byte goes too;
    n_chars counts the text that is left; a document that was repeated throughout stays, empty."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not s else kept_bytes(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pc.if_else(pc.is_null(columns[at]), columns[chars], pc.utf8_length(columns[at]).cast(columns[chars].type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return with_spans(docs).mapInArrow(slim(run), schema)
