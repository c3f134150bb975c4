"""Operator 6, n-gram Jaccard join: documents whose sets of five-word shingles have similarity 0.75 or more.

Method: the incidence matrix of documents and shingles, multiplied with itself in blocks, as a sparse product: a
row of the product accumulates, from the columns that one document has, how many every other document of the
block shares with it, and what is under the size-derived bound is discarded. What is multiplied follows from
the same bounds: two sets of sizes a and b link only if they share 3 (a + b) / 7 shingles, so that in any fixed
order of all shingles the first a - ceil(3a/4) + 1 of a set hold one that both share. Only those columns are
shuffled.

Documents of one column are candidates for each other. Those of a column of at most MOST documents are paired;
those of a wider one are first paired with pivots, the first and the last document of each size class, which
makes as many pairs as the column has documents. Candidate pairs are thinned by a bound from parity bitmaps (the
bitmaps of two sets differ in no more bits than the sets differ in elements) and multiplied, and what links is
contracted. Documents of a wide column that are one group by then need no more; where several groups are left,
blocks of the column are multiplied with each other, skipping pairs that are of one group, and a spanning forest
of the links between groups comes out, never all pairs.

The order of the columns is by hash, with frequent shingles last. Which are put last, and which are dealt to
SALTS tasks when columns are counted, is a hint taken from the documents whose hash falls in 1 of SAMPLE; any
choice gives the same links, as the bound holds in every order, so that only work depends on it. HINTS bounds its
size (8 bytes each), which is broadcast.

Copies with equal sets are one row of the matrix, whatever their doc_ids. Shingles are told apart by 64-bit hashes,
sets as wholes by 128 bits: a row's number is half of them, and sets that share a number get new ones.

Defined results: null, empty or blank texts have 0 shingles and link with nothing; fewer than five words are
one shingle; repeated rows are one document and appear as often as before; rows that share a doc_id with
different texts are distinct sets of one component; a row without doc_id links like any other, counts for no
component's smallest id, and has a null component where no row of the component has an id; an empty table
gives an empty one; other columns are ignored. No partner or candidate is dropped. Memory of a task: one Arrow
batch or two blocks of BLOCK sets, fewer where sets are large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import bounded_batches, discard, plain_names, release, slim, table, written
from rasterloom.operators.components import components

WORDS = 5
#: Columns of so many documents are paired; wider ones begin with pivots.
MOST = 64
BLOCK = 512
#: Elements of a set that count as one document's when blocks are filled.
USUAL = 500
SAMPLE = 16
OFTEN = 3
#: Occurrences in the sample from which a column is dealt to SALTS tasks for counting, and taken to be wide.
HOT = 64
SALTS = 64
HINTS = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of shingles of a text, as sorted hashes."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out = (out + h[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(total: int) -> int:
    """Shared elements that two sets of so many in all must have to link."""
    return -(-3 * total // 7)


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of elements fall on it; the width is a power of two, from 2 bits an element."""
    width = max(256, 1 << (2 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, p: bytes, m: int, q: bytes) -> bool:
    differ = n + m - 2 * least_overlap(n + m)
    if differ < abs(n - m):
        return False
    x, y, size = int.from_bytes(p, "little"), int.from_bytes(q, "little"), len(p)
    a, b, wide, narrow = (x, y, len(p), len(q)) if len(p) >= len(q) else (y, x, len(q), len(p))
    while wide > narrow:  # folding a wide bitmap keeps the bound
        wide //= 2
        a = (a >> 8 * wide) ^ (a & ((1 << 8 * wide) - 1))
    return (a ^ b).bit_count() <= differ


def hints(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, put last in the order, and the very frequent ones: hints that change work, not links."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            s, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

    counted = sample.mapInArrow(slim(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = counted.orderBy(F.desc("n"), "s").limit(HINTS).toPandas()
    s = rows["s"].to_numpy(np.int64).view(np.uint64)
    return np.sort(s), np.sort(s[rows["n"].to_numpy() >= HOT])


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in some (sorted)."""
    if not len(some):
        return np.zeros(len(x), bool)
    at = np.searchsorted(some, x)
    at[at == len(some)] = 0
    return some[at] == x


def prefix_of(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The elements of a set that the size bound asks to look at: by hash, frequent ones last."""
    if len(often):
        late = among(s, often)
        s = np.concatenate([s[~late], s[late]])
    return s[: len(s) + 1 - -(-3 * len(s) // 4)]


def text_hash() -> list[Column]:
    """128 bits of a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


#: Bytes of the number that stands for a set, up to 8.
NUMBER_BYTES = 8


def names_of(s: np.ndarray, size: int) -> tuple[int, int]:
    """Two halves of a set's hash: the number that stands for it, and what tells it from others with that number."""
    h = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:size], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def renumbered(names: DataFrame) -> DataFrame | None:
    """u, v, node: new numbers, which no other set has, of all but one of the sets that share a number; None if none do.
    names: u, v of each set."""
    names = names.distinct()
    shared = names.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("z")).filter("a <> z").select("u", "a")
    others = written(names.sparkSession, names.join(shared, "u").filter("v <> a").select("u", "v"), "shared")
    seed = 0
    while others.head(1):
        seed += 1
        new = others.withColumn("node", F.xxhash64(F.lit(seed), "u", "v"))
        clash = new.join(names.select(F.col("u").alias("node")), "node", "left_semi").select("node")
        if not clash.union(new.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")).head(1):
            return new
    discard(others)
    return None


def with_numbers(df: DataFrame, new: DataFrame | None) -> DataFrame:
    """df (with u and v) with the new numbers in place of u, and without v."""
    if new is None:
        return df.drop("v")
    return df.join(new, ["u", "v"], "left").withColumn("u", F.coalesce("node", "u")).drop("v", "node")


def rows_of(docs: DataFrame, last: Broadcast) -> DataFrame:
    """doc_id, u and v (its set), n and text hashes of every row; prefix and parity too in the first row of a set in its
    Arrow batch. last: the elements that come last in the order."""
    kind, size = docs.schema["doc_id"].dataType.simpleString(), NUMBER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = last.value[0]
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            names = [names_of(s, size) for s in sets]
            first = {u: i for i, u in reversed(list(enumerate(names)))}
            prefix, bits = [None] * len(sets), [None] * len(sets)
            for i in first.values():
                if len(sets[i]):
                    prefix[i] = prefix_of(sets[i], often).tobytes()
                    bits[i] = parity(sets[i])
            halves = [pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)]
            arrays = [*halves, pa.array([len(s) for s in sets], pa.int64()), b.column(2), b.column(3), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "u", "v", "n", "h1", "h2", "prefix", "parity"])

    narrow = docs.select("doc_id", F.col("text").cast("string"), *text_hash())
    return narrow.mapInArrow(slim(run), f"doc_id {kind}, u long, v long, n long, h1 long, h2 long, prefix binary, parity binary")


def representatives(rows: DataFrame) -> DataFrame:
    """rep, n, prefix, parity: one row per distinct set. What a reader does not ask for is not shuffled."""
    return rows.filter(F.col("prefix").isNotNull()).select(F.col("u").alias("rep"), "n", "prefix", "parity").dropDuplicates(["rep"])


def postings(reps: DataFrame, last: Broadcast) -> DataFrame:
    """s, rep, n for each element of each prefix whose column has other documents, and whether the column is wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = last.value[1]
        for b in batches:
            parts = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            size = np.array([len(x) for x in parts], np.int64)
            if not len(size):
                continue
            s, at = np.concatenate(parts), pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(among(s, hot)), b.column(0).take(at), b.column(1).take(at)], ["s", "hot", "rep", "n"])

    rows = reps.select("rep", F.col("n").cast("int").alias("n"), "prefix").mapInArrow(slim(run), "s long, hot boolean, rep long, n int")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(0)))
    counted = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("s", "salt")))
    return counted.filter(F.col("hot") | (F.col("k") > 1)).select("s", "rep", "n", (F.col("hot") | (F.col("k") > MOST)).alias("wide"))


def size_class(n: Column) -> Column:
    """Sizes that link are of one class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(4 / 3)).cast("int")


def may_differ(nx: Column, ny: Column) -> Column:
    return (4 * nx >= 3 * ny) & (4 * ny >= 3 * nx)


def named_pairs(columns: DataFrame) -> DataFrame:
    """x, y: the pairs of narrow columns, and those of wide columns' documents with pivots."""
    narrow = columns.filter(~F.col("wide")).select("s", "rep", "n")
    pairs = narrow.toDF("s", "x", "nx").join(narrow.toDF("s", "y", "ny"), "s").filter((F.col("x") < F.col("y")) & may_differ(F.col("nx"), F.col("ny")))
    wide = columns.filter("wide").select("s", "rep", "n", size_class(F.col("n")).alias("class"))
    ends = wide.groupBy("s", "class").agg(F.min("rep").alias("one"), F.max("rep").alias("two"))
    near = F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class")
    pivots = ends.select("s", near, F.array("one", "two").alias("p")).select("s", "class", F.explode("p").alias("pivot"))
    led = wide.join(pivots, ["s", "class"]).filter(F.col("rep") != F.col("pivot"))
    return pairs.select("x", "y").union(led.select(F.least("rep", "pivot"), F.greatest("rep", "pivot"))).distinct()


def candidate_pairs(columns: DataFrame, own: DataFrame) -> DataFrame:
    """x, y: the named pairs that sizes and bitmaps (own: rep, n, parity) don't exclude."""
    both = named_pairs(columns).join(own.toDF("x", "nx", "px"), "x").join(own.toDF("y", "ny", "py"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nx, px, ny, py = (b.column(i).to_pylist() for i in range(2, 6))
            keep = pa.array([may_link(*z) for z in zip(nx, px, ny, py)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["x", "y"])

    return both.select("x", "y", "nx", "px", "ny", "py").mapInArrow(slim(run), "x long, y long")


def sets_of(docs: DataFrame, wanted: DataFrame, new: DataFrame | None) -> DataFrame:
    """rep, set (packed) of the wanted sets, from the whole texts whose hashes wanted gives."""
    size = NUMBER_BYTES
    texts = docs.select(*text_hash(), F.col("text").cast("string").alias("text")).filter("text is not null").dropDuplicates(["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            halves = zip(*[names_of(s, size) for s in sets]) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in halves), pa.array([s.tobytes() for s in sets], pa.binary())], ["u", "v", "set"])

    found = texts.join(wanted, ["h1", "h2"], "left_semi").select("text").mapInArrow(slim(run), "u long, v long, set binary")
    return with_numbers(found, new).withColumnRenamed("u", "rep")


class Incidence:
    """Rows of the matrix, in compressed form, over the columns that they have."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        columns, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.at, self.mine = at.astype(np.int32), np.zeros(len(columns), bool)

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """The product of row i with others: how many of its columns each of them has."""
        own = self.at[self.start[i] : self.start[i] + self.size[i]]
        size = self.size[others]
        base = np.cumsum(size) - size
        self.mine[own] = True
        hit = self.mine[self.at[np.arange(size.sum()) + np.repeat(self.start[others] - base, size)]]
        self.mine[own] = False
        return np.add.reduceat(hit, base, dtype=np.int64) if len(others) else size

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether row i shares with others as much as the bound asks for."""
        return 7 * self.overlaps(i, others) >= 3 * (self.size[i] + self.size[others])


def pair_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that link, counted on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: dict[bytes, int] = {}
            x, y = (np.array([number.setdefault(p, len(number)) for p in b.column(k).to_pylist()], np.int64) for k in (2, 3))
            m = Incidence([np.frombuffer(p, np.uint64) for p in number])
            keep, order = np.zeros(len(x), bool), np.argsort(x, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
                if len(part):
                    keep[part] = m.linked(x[part[0]], y[part])
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    joined = pairs.join(sets.toDF("x", "p"), "x").join(sets.toDF("y", "q"), "y")
    return joined.select("x", "y", "p", "q").mapInArrow(slim(run), "a long, b long")


def forest(labels: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between the groups (by label) of one block's documents and another's; blocks
    says which block a document is of. Documents that are of one group by now are not multiplied again."""
    m, n, group = Incidence(sets), np.array([len(x) for x in sets]), labels.copy()
    one, two = blocks.min(initial=blocks.max(initial=0)), blocks.max(initial=0)
    out = []
    for i in np.flatnonzero(blocks == one):
        others = np.flatnonzero((group != group[i]) & (blocks == two) & (4 * n >= 3 * n[i]) & (4 * n[i] >= 3 * n))
        others = others[others > i] if one == two else others
        for j in others[m.linked(i, others)]:
            if group[i] != group[j]:
                out.append((int(labels[i]), int(labels[j])))
                group[group == group[j]] = group[i]
    return out


def open_columns(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """s, rep, n, label: the wide columns whose documents are of several groups."""
    wide = columns.filter("wide").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    wide = wide.select("s", "rep", "n", F.coalesce("label", "rep").alias("label"))
    several = wide.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("s")
    return wide.join(several, "s")


def block_links(wide: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between the groups of each wide column, block against block. Blocks are of one size class, and of
    one group where that has half a block or more; blocks of one group are not multiplied with each other."""
    wide = wide.withColumns({"class": size_class(F.col("n")), "load": F.greatest("n", F.lit(USUAL)).cast("long")})
    spark = wide.sparkSession  # what is joined back is written, so that a hot group can be split as a skewed join side
    large = wide.groupBy("s", "class", "label").agg(F.sum("load").alias("w")).filter(F.col("w") >= BLOCK * USUAL // 2).select("s", "class", "label", F.col("label").alias("whole"))
    wide = wide.join(written(spark, large, "large"), ["s", "class", "label"], "left").withColumns({"one": F.col("whole").isNotNull(), "of": F.coalesce("whole", F.lit(0))})
    loads = wide.groupBy("s", "class", "one", "of").agg(F.ceil(F.sum("load") / (BLOCK * USUAL)).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    numbered = wide.join(written(spark, loads, "loads"), ["s", "class", "one", "of"]).select("s", "rep", "n", "label", "one", "of", F.xxhash64("class", "one", "of", part).alias("k"))
    ranges = numbered.groupBy("s", "k", "one", "of").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    i, j = ranges.toDF("s", "i", "ione", "iof", "ilo", "ihi"), ranges.toDF("s", "j", "jone", "jof", "jlo", "jhi")
    meet = (F.col("i") <= F.col("j")) & (4 * F.col("ihi") >= 3 * F.col("jlo")) & (4 * F.col("jhi") >= 3 * F.col("ilo"))
    tasks = i.join(j, "s").filter(meet & ~(F.col("ione") & F.col("jone") & (F.col("iof") == F.col("jof"))))
    tasks = tasks.select("s", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("k"))
    rows = numbered.join(tasks, ["s", "k"]).join(sets, "rep").select("s", "i", "j", "k", "label", "set")

    def run(group: pa.Table) -> pa.Table:
        k, labels = (group.column(c).to_numpy() for c in ("k", "label"))
        found = forest(labels, np.unique(k, return_inverse=True)[1], [np.frombuffer(p, np.uint64) for p in group.column("set").to_pylist()])
        if len(k) > BLOCK:
            release()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("s", "i", "j").applyInArrow(run, "a long, b long")


def shared_ids(members: DataFrame) -> DataFrame:
    """a, b: links between the sets of one doc_id, a star for each."""
    held = members.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "u")
    several = held.groupBy("doc_id").agg(F.min("u").alias("a"), F.max("u").alias("z")).filter("a <> z").select("doc_id", "a")
    return held.join(several, "doc_id").filter("u <> a").select("a", F.col("u").alias("b")).distinct()


def members_of(docs: DataFrame) -> DataFrame:
    """doc_id, u (set), n, h1, h2 and label (of the set's group) and class (the group's smallest doc_id) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    last = spark.sparkContext.broadcast(hints(docs))
    rows = raw = written(spark, rows_of(docs, last), "rows")
    new = renumbered(raw.filter(F.col("prefix").isNotNull()).select("u", "v"))
    rows = with_numbers(raw, new)
    members = written(spark, rows.select("doc_id", "u", "n", "h1", "h2"), "members")
    reps = representatives(rows)  # read twice, for prefixes and for bitmaps, each without the other
    columns = written(spark, postings(reps, last), "columns")
    own = written(spark, reps.select("rep", "n", "parity"), "own")
    discard(raw)
    pairs = written(spark, candidate_pairs(columns, own), "pairs")
    discard(own)
    asked = pairs.select(F.col("x").alias("u")).union(pairs.select("y")).union(columns.filter("wide").select("rep")).distinct()
    texts = members.filter("n > 0").groupBy("u").agg(F.min(F.struct("h1", "h2")).alias("h"))
    sets = written(spark, sets_of(docs, texts.join(asked, "u").select("h.h1", "h.h2"), new), "sets")
    links = written(spark, pair_links(pairs, sets).union(shared_ids(members)), "links")
    labels = components(links)
    discard(pairs, links)
    left = written(spark, open_columns(columns, labels), "open")
    discard(columns)
    if left.head(1):
        more = written(spark, block_links(left, sets), "more")
        joined = components(more).toDF("label", "to")
        merged = labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        alone = joined.join(labels, joined["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
        labels = written(spark, merged.union(alone), "labels")
        discard(more)
    discard(left, sets)
    # rows meet their set's group on the set, never copies with copies; a hot set is split as a skewed join side
    known = members.filter("n > 0").groupBy("u").agg(F.min("doc_id").alias("id")).join(labels.withColumnRenamed("node", "u"), "u", "left")
    known = known.select("u", "id", F.coalesce("label", "u").alias("label"))
    least = known.groupBy("label").agg(F.min("id").alias("class"))
    known = known.select("u", "label").join(written(spark, least, "least"), "label")
    return members.join(known, "u", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    component = F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id"))
    return members_of(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


@plain_names
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and of several rows with that
    doc_id one for each set of shingles. Of a group without any doc_id one row stays. Rows without words stay, once
    for each doc_id and text. Columns besides doc_id and text are taken from one of equal rows."""
    members = members_of(docs)
    words = F.col("n") > 0
    hashes = F.min(F.struct("h1", "h2")).alias("h")
    named = members.filter(words & (F.col("class") == F.col("doc_id"))).groupBy("doc_id", "u").agg(hashes).select("doc_id", "h.h1", "h.h2")
    nameless = members.filter(words & F.col("class").isNull()).groupBy("label").agg(hashes).select(F.lit(None).alias("doc_id"), "h.h1", "h.h2")
    keep = named.union(nameless).union(members.filter(~words).select("doc_id", "h1", "h2").distinct())
    key = lambda df: df.withColumns({"k1": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "k2": F.col("doc_id").isNull()})
    one = key(docs.select("*", *text_hash())).dropDuplicates(["k1", "k2", "h1", "h2"])
    return one.join(key(keep).drop("doc_id"), ["k1", "k2", "h1", "h2"], "left_semi").select(*docs.columns)
