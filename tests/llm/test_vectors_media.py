"""Operators 11 to 13 against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import AWKWARD, SF, corpus, documents, empty

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, cell int, u long"


def vectors(spark, n=260, dims=64, seed=1):
    """Rows in clumps, with repeated ones, and ones that take no part."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, dims))
    x = (middles[rng.integers(0, 7, n)] + 0.3 * rng.normal(size=(n, dims))) / 4
    rows = [(i, [float(v) for v in r], int(rng.integers(0, 10))) for i, r in enumerate(x.astype(np.float32))]
    rows += [rows[3], rows[7], (900, rows[7][1], rows[7][2]), (1400, rows[11][1], 3), (None, rows[5][1], 4), (901, [0.0] * dims, 1), (902, [0.0] * dims, 1)]
    odd = [(800, None, 1), (801, [float("nan")] + [0.0] * (dims - 1), 2), (802, [float("inf")] * dims, 2), (803, [None] + [0.0] * (dims - 1), 2)]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)


def clusters_by_brute_force(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * v) for v in x]) for i, x, _ in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [x for _, x in first[:k]]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((distance(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, x in kept:
            of[nearest(x)[1]].append(x)
        centroids = [[sum(v) // len(of[j]) for v in zip(*of[j])] if of[j] else c for j, c in enumerate(centroids)]
    got = [(i, *nearest(x)) for i, x in kept]
    by = collections.Counter()
    for _, d, j in got:
        by[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, by[j], sum(by.values()), digest[j]) for i, d, j in got)


def run_op(monkeypatch, module, df, op):
    monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: df)
    return collections.Counter(tuple(r) for r in op(df.sparkSession, SF).collect())


@pytest.mark.parametrize("n", [260, 4])
def test_clusters_equal_brute_force(spark, monkeypatch, n):
    from rasterloom.llm import centroid_clustering as c

    rows, odd = vectors(spark)
    rows = rows if n > 100 else rows[:n]
    short = [(804, [1.0] * 63, 1), (805, [1.0] * 65, 1), (806, [], 1)]
    got = run_op(monkeypatch, c, frame(spark, rows + odd + short), c.op11_centroid_clustering)
    assert got == clusters_by_brute_force(rows)
    assert not run_op(monkeypatch, c, frame(spark, odd), c.op11_centroid_clustering)
    assert not run_op(monkeypatch, c, frame(spark, rows).limit(0), c.op11_centroid_clustering)


def test_screening_bounds_and_ties():
    from rasterloom.llm.centroid_clustering import Screen, compress

    rng = np.random.default_rng(2)
    middles = rng.integers(-100, 100, (12, 64))
    x = middles[rng.integers(0, 12, 500)] + rng.integers(-9, 9, (500, 64))
    centroids = np.concatenate([middles, middles[:3]])  # equal centroids: the smaller number wins
    best, d, exact = Screen(centroids).nearest(x, *compress(x))
    every = ((x[:, None] - centroids) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (d == every.min(1)).all()
    assert exact < 3 * len(x)  # most centroids were screened out
    big = rng.integers(-(1 << 24), 1 << 24, (50, 64))
    _, d, _ = Screen(big[:9]).nearest(big, *compress(big))
    assert d.tolist() == [min(sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in big[:9]) for v in big]


def negatives_by_brute_force(rows, every):
    kept = [(k, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * v) for v in x]) for k, (i, x, y) in enumerate(rows)]
    out = collections.Counter()
    for k, i, y, q in kept:
        if i is None or i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, p)), math.inf if j is None else j, m, z == y, j) for m, j, z, p in kept if m != k)
        for score, _, _, _, positive in [r for r in s if r[3]][:5]:
            fits = [r for r in s if not r[3] and 80 * -score <= 100 * -r[0] <= 100 * -score]
            for rank, (n, _, _, _, negative) in enumerate(fits[:5], 1):
                out[(i, positive, rank, negative, -score, -n)] += 1
    return out


@pytest.mark.parametrize("per_pivot,part", [(1, 1), (10, 16), (10**6, 16)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, per_pivot, part):
    from rasterloom.llm import hard_negatives as h

    rows, odd = vectors(spark)
    rows += [(i, x[:40], y) for i, x, y in rows[20:30]] + [(1000, [], 2)]  # shorter vectors
    unlabelled = [(807, rows[0][1], None), (700, rows[1][1], None)]
    monkeypatch.setattr(h, "EVERY", 5)
    monkeypatch.setattr(h, "ANCHORS", 8)
    monkeypatch.setattr(h, "BLOCK_BYTES", 4 * 64 * 30)
    monkeypatch.setattr(h, "BLOCKS_PER_PART", part)
    out = h.hard_negatives(frame(spark, rows + odd + unlabelled), per_pivot=per_pivot)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert collections.Counter(tuple(r) for r in out.collect()) == negatives_by_brute_force(rows, 5)


def test_hard_negatives_without_anchors(spark):
    from rasterloom.llm import hard_negatives as h

    rows, odd = vectors(spark)
    for some in (odd, [r for r in rows if r[0] is None or r[0] % 100]):
        assert h.hard_negatives(frame(spark, some)).count() == 0
    assert h.hard_negatives(frame(spark, rows).limit(0)).count() == 0


def test_bounds_send_less_than_all(spark):
    """Rows of far-off clumps are sent to none of the others' groups."""
    from rasterloom.llm import hard_negatives as h

    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(8, 64), 200, axis=0) + 0.01 * rng.normal(size=(1600, 64))
    df = frame(spark, [(i, [float(v) for v in r], int(rng.integers(0, 3))) for i, r in enumerate(x)])
    rows = h.prepared(df).persist()
    cells = h.cells_of(rows, per_pivot=1)
    anchors = h.placed(rows, cells).persist()
    low = anchors.withColumn("low", 0.8 * anchors["square"])
    near, far = h._reach(low, cells.most, "low", None)
    n = sum(len(r["ids"]) for r in h.sent(rows, cells, near, far, None).collect())
    assert n < 0.5 * 1600 * anchors.select("cell").distinct().count()
    rows.unpersist()
    anchors.unpersist()


# JPEG


def codes_of(lengths):
    out, code = {}, 0
    for n in range(1, 17):
        for symbol in [s for s, k in lengths if k == n]:
            out[symbol] = format(code, f"0{n}b")
            code += 1
        code <<= 1
    return out


def jpeg(width, height, sampling, every, seed, together=True):
    """A baseline image of random coefficients, symbol by symbol, with the first component's DC coefficients."""
    rng = random.Random(seed)
    dc = [(s, 4) for s in range(12)]
    symbols = [0, 0xF0, *sorted({r << 4 | s for r in range(16) for s in range(1, 6)})]
    ac = [(s, 2 if s == 0 else 8) for s in symbols]
    tables = [codes_of(dc), codes_of(ac)]
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    spec = lambda k, x: bytes([k, *(sum(1 for _, n in x if n == m) for m in range(1, 17)), *(s for _, s in sorted((n, i) for i, (_, n) in enumerate(x)) for s in [x[s][0]])])
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xFE, b"a remark \xff\xd9")
    out += segment(0xDB, b"\0" + bytes([4] * 64) + b"\x11" + b"\0\x10" * 64) + b"\xff"
    n = len(sampling)
    out += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, h << 4 | v, k > 0]) for k, (h, v) in enumerate(sampling)))
    out += segment(0xC4, spec(0, dc) + spec(0x10, ac))
    if every:
        out += segment(0xDD, every.to_bytes(2, "big"))
    top = max(h for h, _ in sampling), max(v for _, v in sampling)
    number = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    light = {}

    def scan(comps, units, across):
        nonlocal out
        out += segment(0xDA, bytes([len(comps), *(b for c in comps for b in (c + 1, 0)), 0, 63, 0]))
        bits, before = "", dict.fromkeys(comps, 0)
        for u in range(units):
            if every and u and u % every == 0:
                out += packed(bits) + bytes([0xFF] * rng.randint(1, 2)) + bytes([0xD0 + (u // every - 1) % 8])
                bits, before = "", dict.fromkeys(comps, 0)
            for c in comps:
                h, v = sampling[c] if len(comps) > 1 else (1, 1)
                for b in range(h * v):
                    value = rng.choice([0, rng.randint(-1000, 1000), before[c]])
                    d, before[c] = value - before[c], value
                    bits += tables[0][abs(d).bit_length()] + number(d)
                    if c == 0:
                        light[(u // across * v + b // h, u % across * h + b % h)] = value
                    at = 1
                    while at < 64 and rng.random() < 0.5:
                        run = min(rng.randint(0, 17), 63 - at)
                        while run > 15:
                            bits, at, run = bits + tables[1][0xF0], at + 16, run - 16
                        x = rng.choice([-1, 1]) * rng.randint(1, 31)
                        bits += tables[1][run << 4 | abs(x).bit_length()] + number(x)
                        at += run + 1
                    if at < 64:
                        bits += tables[1][0]
        out += packed(bits)

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0")

    up = lambda a, b: -(-a // b)
    if together and n > 1:
        across = up(width, 8 * top[0])
        scan(range(n), across * up(height, 8 * top[1]), across)
    else:
        for c, (h, v) in enumerate(sampling):
            across = up(up(width * h, top[0]), 8)
            scan([c], across * up(up(height * v, top[1]), 8), across)
    shown = [[min(255, max(0, ((light[y, x] * 4 + 4) >> 3) + 128)) for x in range(up(width, 8))] for y in range(up(height, 8))]
    return out + b"\xff\xd9", shown


def test_jpeg_thumbnails_equal_what_was_written():
    from rasterloom.llm.media_columns import Picture, pictures

    made = [jpeg(w, h, s, e, k, t) for k, (w, h, s, e, t) in enumerate([
        (1, 1, [(1, 1)], 0, True), (100, 37, [(1, 1)], 0, True), (64, 64, [(1, 1)], 3, True), (75, 50, [(2, 2), (1, 1), (1, 1)], 0, True), (75, 50, [(2, 1), (1, 1), (1, 1)], 4, True),
        (33, 70, [(1, 1), (1, 1), (1, 1)], 2, False), (500, 20, [(1, 1), (1, 1), (1, 1)], 9, True)])]
    broken = [made[1][0][:-30], made[2][0].replace(b"\xff\xd1", b"\xff\xd2" * 2, 1), b"", b"GIF89a", None, b"\xff\xd8\xff\xd9", made[1][0].replace(b"\xff\xc0", b"\xff\xc2")]
    got = pictures([x for x, _ in made] + broken)
    for (_, want), p in zip(made, got):
        assert isinstance(p, Picture) and p.thumbnail.tolist() == want
    assert got[-3] is None and all(isinstance(p, str) for k, p in enumerate(got[len(made) :]) if k != 4)
    half = made[1][0]
    for at in range(200, len(half), 37):  # flipped bits give an error or another image, and never a crash
        assert pictures([half[:at] + bytes([half[at] ^ 0x55]) + half[at + 1 :]])
    assert (got[3].width, got[3].height, got[3].components) == (75, 50, 3)


def test_stored_bytes_read_back(monkeypatch):
    from rasterloom.llm import media_columns as m

    rng = random.Random(4)
    payloads = [m.padded(bytes(rng.randrange(256) for _ in range(n))) for n in (0, 1, 191, 192, 193, 5000, 192 * 30)] + [b"\xff" * 384, b"\0\xff" * 960]
    monkeypatch.setattr(m, "MOST_ROWS", 7)
    monkeypatch.setattr(m, "PIECE_ROWS", 5)
    monkeypatch.setattr(m, "PIECE_BYTES", 900)
    got = m.pictures(m.stored(payloads))
    assert [p.thumbnail.tobytes() for p in got] == payloads
    assert (got[-3].frames, got[-3].height, got[-3].width) == (5, 240, 1536)


def test_average_hash_of_parts():
    from rasterloom.llm.media_columns import average_hash

    for shape in ((1, 192), (3, 5), (8, 8), (61, 100)):
        t = np.random.default_rng(5).integers(0, 256, shape)
        want = 0
        for i in range(8):
            for j in range(8):
                rows, columns = (slice(k * n // 8, max((k + 1) * n // 8, k * n // 8 + 1)) for k, n in ((i, shape[0]), (j, shape[1])))
                want = want * 2 + bool(t[rows, columns].mean() > t.mean())
        assert average_hash(t.astype(np.uint8)) == want


def test_media_columns_of_documents(spark, monkeypatch):
    from rasterloom.llm import media_columns as m

    texts = [t for t in corpus(spark, 20)] + ["long é " * 40_000] + AWKWARD
    df = documents(spark, texts, ids=[*range(len(texts) - 3), None, None, 4])
    got = run_op(monkeypatch, m, df, m.op12_media_columns)
    want = collections.Counter()
    by_text = {}
    for r in got.elements():
        by_text.setdefault(r[3], set()).add(r[1:])
    for i, t in zip([*range(len(texts) - 3), None, None, 4], texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        digest = hashlib.sha256(payload).hexdigest()
        assert any(r[0] == len(data) for r in by_text[digest])
        want[(i, len(data), len(payload), digest, zlib.crc32(payload[-16:]))] += 1
    assert collections.Counter(r[:5] for r in got.elements()) == want
    assert all(len({r[4:] for r in rows}) == 1 for rows in by_text.values())  # equal texts, equal values
    assert not run_op(monkeypatch, m, empty(spark), m.op12_media_columns)


def test_thumbnail_table(spark):
    from rasterloom.llm.media_columns import thumbnails

    data, shown = jpeg(40, 24, [(1, 1)], 2, 9)
    rows = [(1, data), (2, b"no image"), (3, None), (None, data), (1, data)]
    df = spark.createDataFrame([(i, d, 5) for i, d in rows], "page long, `a.b` binary, width int").repartition(2)
    got = thumbnails(df, "page", "a.b").collect()
    assert collections.Counter((r["page"], r["width"], r["height"], r["error"] is None) for r in got) == {(1, 40, 24, True): 2, (None, 40, 24, True): 1, (2, None, None, False): 1, (3, None, None, True): 1}
    assert {bytes(r["thumbnail"]) for r in got if r["thumbnail"]} == {bytes(v for line in shown for v in line)}
    assert thumbnails(df.limit(0), "page", "a.b").count() == 0


def test_what_waits_for_blocks_is_bounded_over_many_cells():
    """One batch that goes to 1,000 cells: 256 MB of vectors if all of them waited."""
    import pyarrow as pa

    from rasterloom.llm import hard_negatives

    q = np.random.default_rng(5).integers(-99, 99, (1000, 64)).astype("<i4")
    square = (q.astype(np.int64) ** 2).sum(1)
    number = pa.array(range(1000), pa.int64())
    batch = pa.RecordBatch.from_arrays([number, number, number, pa.array(square), pa.array([v.tobytes() for v in q], pa.binary())], ["u", "vec_id", "label", "square", "q"])
    cells = hard_negatives.Cells(q, int(square.max()))
    before, rows, most = pa.total_allocated_bytes(), 0, 0
    for block in hard_negatives.dealt(iter([batch]), cells, np.full(1000, -np.inf), np.full(1000, np.inf), None):
        rows += len(block.column("ids")[0])
        most = max(most, pa.total_allocated_bytes() - before)
    assert rows == 1000 * 1000 and most < 3 * hard_negatives.HELD_BYTES


def test_blocks_are_written_in_small_row_groups(spark):
    """64 rows of 512 KB; by Parquet's own sizes they are one group."""
    import pathlib

    import pyarrow.parquet as pq

    from rasterloom.llm import hard_negatives
    from rasterloom.sources.shared import discard, written

    rows = spark.createDataFrame([(k, np.random.default_rng(k).bytes(1 << 19)) for k in range(64)], "id long, x binary").coalesce(1)
    table = written(rows, "groups", hard_negatives.GROUP_BYTES)
    (file,) = pathlib.Path(table._written_at.removeprefix("file://")).glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert table.count() == 64 and max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= 24
    discard(table)
