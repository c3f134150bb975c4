"""Byte-pair merges as a pair-compatibility table.

A merge list assigns every token a time: the rank of the merge that makes it. Two tokens can stand side by
side in the finished encoding exactly if no merge across their border would have come before the merges that
made them. compatible() replays the border backwards in time and remembers its answers; with it, an encoding
is any segmentation whose neighbours are all compatible, and there is one such segmentation.
"""

from __future__ import annotations

#: Answers of compatible() that one table remembers before it starts anew.
REMEMBERED = 500_000


class MergeTable:
    """Tokens are ints. base: tokens that no merge makes. Other tokens are added by add() in order of rank."""

    def __init__(self) -> None:
        self.time: list[int] = []  # token -> rank of its merge, -1 for base tokens
        self.parts: list[tuple[int, int] | None] = []
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank
        self.known: dict[tuple[int, int], bool] = {}

    def base(self) -> int:
        self.time.append(-1)
        self.parts.append(None)
        return len(self.time) - 1

    def add(self, left: int, right: int, rank: int) -> int:
        self.time.append(rank)
        self.parts.append((left, right))
        self.merged[left, right] = rank
        return len(self.time) - 1

    def replay(self, left: int, right: int) -> bool:
        """Whether the border between left and right survives, looked at from the last merge to the first."""
        time, parts, merged = self.time, self.parts, self.merged
        until = 1 << 60  # merges of this rank or later were not yet due while both sides stood here
        while True:
            rank = merged.get((left, right))
            if rank is not None and rank < until:
                return False
            if time[left] > time[right]:
                until = time[left]
                left = parts[left][1]
            elif time[right] >= 0:
                until = time[right] + 1  # the border lies to the left of that merge and goes first on a tie
                right = parts[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.known
        pair = (left, right)
        answer = known.get(pair)
        if answer is None:
            if len(known) >= REMEMBERED:
                known.clear()
            answer = known[pair] = self.replay(left, right)
        return answer
