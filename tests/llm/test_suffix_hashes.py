"""Suffix dedup: what is removed was found equal byte by byte, and rows are told apart whatever their ids."""

import collections
import random

import numpy as np
import pytest

from tests.llm.test_operators import DEALING, documents, removed_by_brute_force, repeated_rows


def equal(spark, rows):
    from rasterloom.llm import suffix_dedup

    df = documents(spark, [t for _, t in rows], [d for d, _ in rows])
    got = collections.Counter(tuple(r) for r in suffix_dedup.removals(df).collect())
    want = removed_by_brute_force(rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def passages(n, pieces=60):
    """Texts of a few shared passages and own words."""
    rng = random.Random(n)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(90, 260))) for _ in range(pieces)]
    own = lambda k: "".join(rng.choice("stuvwxyz ") for _ in range(k))
    return ["".join(own(rng.randint(0, 70)) + rng.choice(shared) for _ in range(rng.randint(0, 3))) + own(rng.randint(0, 150)) for _ in range(n)]


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: None if i % 3 else i % 40])
def test_rows_that_share_an_id(spark, ids):
    equal(spark, [(ids(i), t) for i, t in enumerate(passages(3000))])


def test_texts_of_one_length_under_one_id(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcd") for _ in range(200))
    equal(spark, [(1, f"{rng.randrange(10**9):09d}" + shared[: rng.randint(0, 150)].ljust(160, "-")) for _ in range(1500)])


def test_many_repeats_of_one_row(spark):
    text = passages(5)[3] + "x" * 300
    equal(spark, [(None, text)] * 400 + [(3, text)] * 50 + [(9, text + "y")])


@pytest.mark.parametrize("sample,hot", DEALING)
def test_forced_collisions(spark, monkeypatch, sample, hot):
    """Segment and window hashes of two bits: nearly everything collides, in a batch, between batches, in hot groups."""
    from rasterloom.llm import suffix_dedup, suffix_sort

    of = suffix_sort.Hashes.of

    def weak(self, start, size):
        full = of(self, start, size)
        return np.where(np.broadcast_to(size, full.shape) >= suffix_dedup.LENGTH, full & np.uint64(3), full)

    monkeypatch.setattr(suffix_sort.Hashes, "of", weak)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    import pyspark.cloudpickle as inner

    for m in (suffix_dedup, suffix_sort):
        inner.register_pickle_by_value(m)
    try:
        equal(spark, repeated_rows())
    finally:
        for m in (suffix_dedup, suffix_sort):
            inner.unregister_pickle_by_value(m)


def test_equal_strings_that_a_collision_parts_are_found(monkeypatch):
    """A hash that puts the order wrong, so that equal strings don't lie together."""
    from rasterloom.llm import suffix_sort

    text = b"aab" * 40 + b"abb" * 40 + b"aab" * 40
    data, starts = np.frombuffer(text, np.uint8), np.arange(0, 340, 3)
    of = suffix_sort.Hashes.of
    monkeypatch.setattr(suffix_sort.Hashes, "of", lambda self, start, size: np.where(np.broadcast_to(size, start.shape) < 8, np.uint64(0), of(self, start, size)))
    order, same = suffix_sort.suffix_order(data, starts, np.zeros(len(starts), np.int64), 8)
    keys = [text[starts[i] : starts[i] + 8] for i in order]
    assert sum(not s for s in same) == len(set(keys))
    assert all(keys[k] == keys[k - 1] for k in range(1, len(keys)) if same[k])
