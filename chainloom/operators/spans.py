"""Sorted spans for folds: add, remove, and the first span that overlaps or lies within another.

Spans are kept in blocks of bounded size that know their furthest and nearest
end, so that a question skips whole blocks and a change touches one of them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

Span = tuple[int, int, int]


class Spans:
    """Distinct (start, end, tag) in ascending order."""

    BLOCK = 256

    def __init__(self) -> None:
        self.blocks: list[list[Span]] = []
        self.firsts: list[Span] = []
        self.furthest: list[int] = []
        self.nearest: list[int] = []

    def _measure(self, k: int) -> None:
        block = self.blocks[k]
        self.firsts[k], self.furthest[k], self.nearest[k] = block[0], max(s[1] for s in block), min(s[1] for s in block)

    def add(self, span: Span) -> None:
        k = max(0, bisect_right(self.firsts, span) - 1)
        if not self.blocks:
            self.blocks, self.firsts, self.furthest, self.nearest = [[span]], [span], [span[1]], [span[1]]
            return
        block = self.blocks[k]
        insort(block, span)
        self.firsts[k], self.furthest[k], self.nearest[k] = block[0], max(self.furthest[k], span[1]), min(self.nearest[k], span[1])
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            for known in (self.firsts, self.furthest, self.nearest):
                known.insert(k, known[k])
            self._measure(k)
            self._measure(k + 1)

    def remove(self, span: Span) -> None:
        k = bisect_right(self.firsts, span) - 1
        block = self.blocks[k]
        del block[bisect_left(block, span)]
        if block:
            self._measure(k)
        else:
            for known in (self.blocks, self.firsts, self.furthest, self.nearest):
                del known[k]

    def overlapping(self, start: int, end: int) -> Span | None:
        """The first span with start < ``end`` and end > ``start``."""
        for k, first in enumerate(self.firsts):
            if first[0] >= end:
                return None
            if self.furthest[k] > start:
                for s in self.blocks[k]:
                    if s[0] >= end:
                        return None
                    if s[1] > start:
                        return s
        return None

    def within(self, start: int, end: int) -> Span | None:
        """The first span with start > ``start`` and end < ``end``."""
        for k in range(max(0, bisect_right(self.firsts, (start, float("inf"), 0)) - 1), len(self.blocks)):
            if self.nearest[k] < end:
                for s in self.blocks[k]:
                    if s[0] > start and s[1] < end:
                        return s
        return None


class CountedSpans(Spans):
    """Spans that several owners may hold; one is there as long as any holds it."""

    def __init__(self) -> None:
        super().__init__()
        self.times: dict[tuple[int, int], int] = {}

    def hold(self, start: int, end: int) -> None:
        n = self.times[start, end] = self.times.get((start, end), 0) + 1
        if n == 1:
            self.add((start, end, 0))

    def release(self, start: int, end: int) -> None:
        self.times[start, end] -= 1
        if not self.times[start, end]:
            del self.times[start, end]
            self.remove((start, end, 0))
