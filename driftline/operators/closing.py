"""The close-and-reset rule over ordered ranges, composed instead of carried.

A chunk closes with the row that brings it up to the limit. Where chunks start
in a range depends on the chunk that the ranges before leave open only through
its size so far, so a range is a small function: from that size to the number
of chunks that start in it, and to the size it leaves open itself. Functions
of neighbouring ranges compose to one of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Rows that are held at once; functions of such blocks compose to that of a range.
BLOCK = 1 << 16


@dataclass
class Open:
    """State between two ranges: the split and size of a chunk that is open, None if none is."""

    split: int | None = None
    size: int = 0


@dataclass
class Range:
    """What a range does, by the size that is open before it.

    Piece ``i`` holds for sizes from ``since[i]`` up to the next one: so many
    chunks start (``starts``), and ``left`` is open after them, -1 if nothing
    is; ``keeps`` adds the size before, where no chunk started and none closed.
    ``fresh`` tells starts and left where nothing of the first split is open.
    """

    first: int
    last: int
    since: np.ndarray
    starts: np.ndarray
    left: np.ndarray
    keeps: np.ndarray
    fresh: tuple[int, int]

    def at(self, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, what is left open, and whether it still holds the size before."""
        piece = np.searchsorted(self.since, size, side="right") - 1
        keeps = self.keeps[piece]
        return self.starts[piece], self.left[piece] + np.where(keeps, size, 0), keeps

    def step(self, before: Open) -> tuple[int, Open]:
        starts, left = self.fresh
        if before.split == self.first:
            starts, left, _ = (value.item() for value in self.at(np.int64(before.size)))
        return int(starts), Open(self.last, int(left)) if left >= 0 else Open()

    def then(self, other: Range) -> Range:
        """This range and the next one as one."""
        same = self.last == other.first

        def on(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts and left of ``other`` for sizes that do not depend on the one before."""
            starts, after, _ = other.at(np.maximum(left, 0))
            fresh = (left < 0) | (not same)
            return np.where(fresh, other.fresh[0], starts), np.where(fresh, other.fresh[1], after)

        starts, left = on(self.left)
        since, keeps, starts = self.since, np.zeros(len(self.since), bool), self.starts + starts
        if self.keeps[0] and same:
            # The first piece hands the size on: it falls into pieces of the other one.
            added = int(self.left[0])
            end = self.since[1] if len(self.since) > 1 else np.iinfo(np.int64).max
            low = np.searchsorted(other.since, added, side="right") - 1
            inside = np.arange(low, len(other.since))
            cuts = np.maximum(other.since[inside] - added, 0)
            inside, cuts = inside[cuts < end], cuts[cuts < end]
            since = np.r_[cuts, since[1:]]
            starts = np.r_[self.starts[0] + other.starts[inside], starts[1:]]
            left = np.r_[other.left[inside] + np.where(other.keeps[inside], added, 0), left[1:]]
            keeps = np.r_[other.keeps[inside], keeps[1:]]
        fresh = on(np.array([self.fresh[1]]))
        made = (int(self.fresh[0] + fresh[0][0]), int(fresh[1][0]))
        return Range(self.first, other.last, since, starts, left, keeps, made).merged()

    def merged(self) -> Range:
        """Neighbouring pieces that say the same are one."""
        new = np.r_[True, (np.diff(self.starts) != 0) | (np.diff(self.left) != 0) | (self.keeps[1:] != self.keeps[:-1])]
        return Range(self.first, self.last, self.since[new], self.starts[new], self.left[new], self.keeps[new], self.fresh)

    def packed(self) -> bytes:
        head = np.array([self.first, self.last, *self.fresh], np.int64)
        return np.r_[head, self.since, self.starts, self.left, self.keeps.astype(np.int64)].tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Range:
        values = np.frombuffer(data, np.int64)
        since, starts, left, keeps = values[4:].reshape(4, -1)
        return cls(int(values[0]), int(values[1]), since, starts, left, keeps.astype(bool), (int(values[2]), int(values[3])))


class Rows:
    """Sizes and splits of a range's rows, and where the next chunk starts after each start."""

    def __init__(self, sizes: np.ndarray, splits: np.ndarray, limit: int):
        self.limit, self.count = limit, len(sizes)
        self.splits = splits
        self.sum = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        # Where the split of each row ends.
        edges = np.r_[np.flatnonzero(np.diff(splits)) + 1, self.count]
        self.ends = edges[np.searchsorted(edges, np.arange(self.count), side="right")]
        full = np.searchsorted(self.sum, self.sum[:-1] + limit, side="left")
        # A chunk has a row at least, and ends with its split.
        self.next = np.minimum(np.maximum(full, np.arange(1, self.count + 1)), self.ends)

    def first_start(self, before: Open) -> int:
        """The first row that starts a chunk."""
        if before.split != self.splits[0]:
            return 0
        return int(self._continued(np.array([before.size]))[0])

    def _continued(self, sizes: np.ndarray) -> np.ndarray:
        full = np.searchsorted(self.sum, self.limit - sizes, side="left")
        return np.minimum(np.maximum(full, 1), self.ends[0])

    def numbers(self, before: Open) -> np.ndarray:
        """How many chunks have started in the range, at each row."""
        starts, at = np.zeros(self.count, np.int64), self.first_start(before)
        following = self.next.tolist()
        while at < self.count:
            starts[at] = 1
            at = following[at]
        return np.cumsum(starts)

    def follow(self, before: Open) -> tuple[np.ndarray, Open]:
        """The numbers, and what the rows leave open."""
        numbers = self.numbers(before)
        if numbers[-1]:
            size = int(self.sum[-1] - self.sum[np.searchsorted(numbers, numbers[-1])])
        else:
            size = before.size + int(self.sum[-1])
        return numbers, Open(int(self.splits[-1]), size) if size < self.limit else Open()

    def function(self) -> Range:
        """Counts of starts by pointer jumping over all rows at once."""
        count = self.count
        inner = self.next < count
        last = np.where(inner, self.next, np.arange(count))
        more = inner.astype(np.int64)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            more, last = more + more[last], further
        # What the chunk that starts last leaves open; nothing if it is full.
        size = self.sum[count] - self.sum[last]
        left = np.where(size >= self.limit, -1, size)

        def after(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Starts and left from a first start on; beyond the rows there is none."""
            inside = np.minimum(start, count - 1)
            return np.where(start < count, 1 + more[inside], 0), np.where(start < count, left[inside], -1)

        end = int(self.ends[0])
        total = int(self.sum[end])
        # The rows that may close the open chunk, by the least size that lets each.
        highest = max(1, int(np.searchsorted(self.sum, self.limit, side="left")))
        closing = np.arange(1, min(highest, end) + 1)
        least = np.maximum(self.limit - self.sum[closing], 0)
        since, place = np.unique(least, return_index=True)
        closing = closing[place]
        starts, remains = after(closing)
        keeps = np.zeros(len(since), bool)
        if since[0] > 0:
            # Below that nothing closes in the first split.
            if end == count:
                below = (0, total, True)
            else:
                found = after(np.array([end]))
                below = (int(found[0][0]), int(found[1][0]), False)
            since, starts, remains, keeps = np.r_[0, since], np.r_[below[0], starts], np.r_[below[1], remains], np.r_[below[2], keeps]
        fresh = after(np.array([0]))
        return Range(
            int(self.splits[0]), int(self.splits[-1]), since, starts, remains, keeps, (int(fresh[0][0]), int(fresh[1][0]))
        ).merged()
