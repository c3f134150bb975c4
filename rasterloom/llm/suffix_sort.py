"""Suffix sort by hash comparison, vectorised.

Prefix polynomial hashes give the hash of any piece of a buffer; binary search over lengths gives how far two
suffixes agree; a bottom-up mergesort orders suffixes with that comparison, all classes at once, each element
finding its place in the neighbouring run by binary search. Equal neighbours are verified byte by byte, and
suffixes with one hash must lie together; a class where either fails was put out of order by a collision and is
sorted by its bytes.
"""

from __future__ import annotations

import numpy as np

_SEEDED = np.random.default_rng(20_240_607)
LETTER = _SEEDED.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
SECOND = _SEEDED.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, b in (("up", BASE), ("down", UNBASE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Hashes of the pieces of a byte buffer; by other letters (SECOND) they are others of the same pieces."""

    def __init__(self, data: np.ndarray, letter: np.ndarray = LETTER) -> None:
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letter[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """How many bytes, limit at most, the suffixes at a and b share: binary search over hash equality."""
    have = np.zeros(len(a), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        fits = have + step <= limit
        more = np.where(fits, step, 0)
        same = fits & (hashes.of(a + have, more) == hashes.of(b + have, more))
        have += np.where(same, step, 0)
        step >>= 1
    return have


def before(data: np.ndarray, hashes: Hashes, a: np.ndarray, b: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    """Whether the first limit bytes at a sort before those at b (or are equal, where or_equal)."""
    n = extension(hashes, a, b, limit)
    full = n >= limit
    at = np.minimum(n, limit - 1)
    return np.where(full, or_equal, data[a + at] < data[b + at])


def suffix_order(data: np.ndarray, starts: np.ndarray, classes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at starts, by class and then by their first limit bytes (ties: as given), and
    for each place whether it equals the one before it in class and bytes, verified byte by byte."""
    hashes = Hashes(data)
    order = np.argsort(classes, kind="stable")
    cls, pos = classes[order], starts[order]
    n = len(order)
    if not n:
        return order, np.zeros(0, bool)
    heads = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    size = np.diff(np.r_[heads, n])
    head, total = np.repeat(heads, size), np.repeat(size, size)
    rank = np.arange(n) - head
    width = 1
    while width < size.max():
        live = np.flatnonzero(total > width)
        r, h, t = rank[live], head[live], total[live]
        run = r // (2 * width) * (2 * width)
        left = r - run < width
        # the other run of the pair, as ranks in the class
        lo = np.where(left, np.minimum(run + width, t), run)
        hi = np.where(left, np.minimum(run + 2 * width, t), run + width)
        other = lo.copy()
        own = pos[live]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            less = before(data, hashes, pos[h[todo] + mid], own[todo], limit, ~left[todo])
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = h + np.where(left, r + (lo - other), run + (r - run - width) + (lo - other))
        new_pos, new_order = pos.copy(), order.copy()
        new_pos[place], new_order[place] = own, order[live]
        pos, order = new_pos, new_order
        width *= 2
    whole = hashes.of(pos, limit)
    fresh = np.r_[True, (cls[1:] != cls[:-1]) | (whole[1:] != whole[:-1])]
    same = np.zeros(n, bool)
    at = np.flatnonzero(~fresh)
    for k in range(0, len(at), 5_000):  # collision check
        i = at[k : k + 5_000]
        span = np.arange(limit)
        same[i] = (data[pos[i][:, None] + span] == data[pos[i - 1][:, None] + span]).all(axis=1)
    runs = np.flatnonzero(fresh)
    runs = runs[np.lexsort((whole[runs], cls[runs]))]
    apart = runs[1:][(cls[runs][1:] == cls[runs][:-1]) & (whole[runs][1:] == whole[runs][:-1])]
    for c in np.unique(cls[np.r_[at[~same[at]], apart]]):  # different strings with one hash
        members = np.flatnonzero(cls == c)
        text = [data[p : p + limit].tobytes() for p in pos[members]]
        by = sorted(range(len(members)), key=lambda i: (text[i], order[members[i]]))
        order[members], pos[members] = order[members][by], pos[members][by]
        same[members] = [i > 0 and text[by[i]] == text[by[i - 1]] for i in range(len(by))]
    return order, same
