"""Operator 9, benchmark decontamination by Wu-Manber multi-pattern search.

Method: the patterns are word windows of the benchmark items, the alphabet is words. For each pattern length
there is a shift table over blocks of BLOCK words, which says how far a search may jump; where it says 0, the
block names a bucket of patterns, and direct comparison confirms an occurrence. Items shorter than the window
have one pattern, of their own length. Equal windows, of one item or of many, are one pattern with a set of owners, and
a bucket of several patterns is looked up by the window's hash, so that neither repeated nor alike windows are compared
one by one.

The benchmark is a stated query set. It is dealt into blocks of BLOCK_WORDS words at most, each sent to the
executors once and run against all rows; with more than one block, what was found so far travels with the rows
and is written between blocks. A longer item is cut into parts that overlap by all but one word of a window. That
bounds what a block's matcher takes in a Python worker (each word begins one pattern at most), not only its text.

Words are runs of ASCII letters and digits, lower-cased, and of all non-ASCII characters. Defined results: a
null text or one without words has no hits, whose item digest is that of the empty string; a null item text
has no windows; rows with one item_id count as one item; an item without item_id hits and counts, as one with all
others of that kind, and is not listed; repeated rows give repeated rows; empty tables give no hits or no rows;
other columns are ignored. A text longer than memory for its words is not split.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, plain_names, slim, table, written

WINDOW = 10
BLOCK = 3
BLOCK_WORDS = 400_000

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def words_of(text: str | None) -> list[bytes]:
    """Lower-casing bytes touches A-Z only."""
    return _WORDS((text or "").encode().lower())


class _OneLength:
    """Distinct patterns of one length, as places in a text of word numbers: the shift of each block, and for shift 0, as
    a negative number, its bucket. A bucket is one pattern's place, or places by the hash of the pattern, so that a
    block that many patterns end with costs one look-up. Equal patterns are one entry with several owners."""

    def __init__(self, length: int, text: array, starts: array, base: int, owner: Callable[[int], object]) -> None:
        self.length, self.block, self.text, self.base = length, min(BLOCK, length), text, base
        self.far = length - self.block + 1
        self.table: dict[int, int] = {}
        self.buckets: list[int | dict[int, int | list[int]]] = []
        #: Owners of a pattern besides that of its place.
        self.shared: dict[int, set] = {}
        size, skip = self.block, self.table
        for start in starts:
            key = self.key(text, start + length - size)
            if (at := skip.get(key, 1)) >= 0:
                skip[key] = -1 - len(self.buckets)
                self.buckets.append(start)
            else:
                first = self._entered(-1 - at, start)
                if first != start:
                    if (who := owner(start)) != owner(first):
                        self.shared.setdefault(first, set()).add(who)
                    continue
            for shift in range(1, self.far):
                key = self.key(text, start + length - shift - size)
                if skip.get(key, self.far) > shift:
                    skip[key] = shift

    def key(self, text, at: int) -> int:
        out = text[at]
        for k in range(at + 1, at + self.block):
            out = out * self.base + text[k]
        return out

    def _entered(self, number: int, start: int) -> int:
        """The place of the pattern at start in a bucket, where it is entered if it is new."""
        window, bucket = self.text[start : start + self.length], self.buckets[number]
        if isinstance(bucket, int):
            old = self.text[bucket : bucket + self.length]
            if old == window:
                return bucket
            bucket = self.buckets[number] = {hash(old.tobytes()): bucket}
        if (first := self._among(bucket, window)) is not None:
            return first
        h = hash(window.tobytes())
        have = bucket.get(h)
        bucket[h] = start if have is None else [have, start] if isinstance(have, int) else [*have, start]
        return start

    def _among(self, bucket: dict[int, int | list[int]], window: array) -> int | None:
        have = bucket.get(hash(window.tobytes()), ())
        for start in (have,) if isinstance(have, int) else have:
            if self.text[start : start + self.length] == window:
                return start
        return None

    def search(self, words: array, hit: bytearray, found: set[int]) -> None:
        length, size, far, text, skip = self.length, self.block, self.far, self.text, self.table
        i, n = length, len(words)
        while i <= n:  # i: the end of the window
            s = skip.get(self.key(words, i - size), far)
            if s > 0:
                i += s
                continue
            bucket = self.buckets[-1 - s]
            window = words[i - length : i]
            if isinstance(bucket, int):
                start = bucket if text[bucket : bucket + length] == window else None
            else:
                start = self._among(bucket, window)
            if start is not None:
                hit[i - length : i] = b"\1" * length
                found.add(start)
            i += 1


class Matcher:
    """items: (item_id, words) each. Words are numbered from 1; 0 stands for those that no item has."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        text, starts, self.owner, self.ends = array("i"), {}, [], []
        for item, words in items:
            size = min(window, len(words))
            if size:
                starts.setdefault(size, array("q")).extend(range(len(text), len(text) + len(words) - size + 1))
                text.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
                self.owner.append(None if item is None else str(item))
                self.ends.append(len(text))
        owner = lambda start: self.owner[bisect_right(self.ends, start)]
        self.lengths = [_OneLength(n, text, x, len(self.number) + 1, owner) for n, x in sorted(starts.items())]

    def search(self, words: list[bytes], hit: bytearray, items: set) -> None:
        number = self.number.get
        numbers = array("i", [number(w, 0) for w in words])
        for x in self.lengths:
            found: set[int] = set()
            x.search(numbers, hit, found)
            for start in found:
                items.add(self.owner[bisect_right(self.ends, start)])
                items.update(x.shared.get(start, ()))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, block) -> Matcher:
    """The matcher of a broadcast block, built once in each worker."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher([(item, words.split(b" ")) for item, words in block.value])
    return _matchers[name]


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list]:
    """Items and their words, joined by spaces, in lists of so many words at most."""
    now, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy(F.col("item_id"), F.col("text")).toLocalIterator():
        words = words_of(r[1])
        step = max(1, most - WINDOW)
        for at in range(0, max(1, len(words) - WINDOW + 1), step) if words else ():
            part = words[at : at + step + WINDOW - 1]
            if now and size + len(part) > most:
                yield now
                now, size = [], 0
            now.append((r[0], b" ".join(part)))
            size += len(part)
    yield now


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs with _hit (a byte per word, 1 where hit) and _items (ids that occur, sorted)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _hit binary, _items array<string>"
    at, width = docs.columns.index("text"), len(docs.columns)

    def step(df: DataFrame, block) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, block)
            for b in batches:
                hits, found = [], []
                olds = zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()) if b.num_columns > width else None
                for text in b.column(at).to_pylist():
                    words = words_of(text)
                    old = next(olds) if olds else (None, ())
                    hit, items = bytearray(old[0] or bytes(len(words))), set(old[1])
                    m.search(words, hit, items)
                    hits.append(bytes(hit))
                    found.append(sorted(items, key=lambda x: (x is not None, x)))
                new = [pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], names=[*b.schema.names[:width], "_hit", "_items"])

        return df.mapInArrow(slim(run), schema)

    df = docs
    for k, block in enumerate(blocks(benchmark)):
        df = step(written(spark, df, "decontamination") if k else df, spark.sparkContext.broadcast(block))
    return df


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    m = marked(docs.select("doc_id", "text"), benchmark).drop("text")
    n_hit = F.length(F.translate(F.hex("_hit"), "0", "")).cast("long")  # a hit is 01, another word 00
    return m.select(
        "doc_id", F.length("_hit").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@plain_names
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    m = marked(docs, table(spark, sf_dir, "benchmark"))
    return m.filter(F.size("_items") == 0).drop("_hit", "_items")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i+size-1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, size, i, array_to_string(w[i:i+size-1], ' ') AS s
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
h AS (SELECT rid, i, size, item_id FROM dw JOIN p USING (size, s)),
n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM h) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
