"""Sequential per-lane planning kernels (numpy / plain Python).

They receive only ``(key, length)`` of one lane, in lane order, and return a
plan: which row (or shard) each document goes to, at which offset, and how
many of its tokens are taken.  Token arrays never enter these functions; the
Spark side joins them back afterwards.  Every function is deterministic.
"""

from __future__ import annotations

import bisect
from collections import deque

import numpy as np


# ----------------------------------------------------------------------------
# Best fit with a bounded buffer.

class _LengthIndex:
    """Buffered items bucketed by length; FIFO inside a bucket (= earliest first)."""

    def __init__(self):
        self.by_len: dict[int, deque] = {}
        self.lens: list[int] = []  # sorted distinct lengths present
        self.size = 0

    def add(self, length: int, item):
        q = self.by_len.get(length)
        if q is None:
            q = self.by_len[length] = deque()
            bisect.insort(self.lens, length)
        q.append(item)
        self.size += 1

    def _pop(self, length: int):
        q = self.by_len[length]
        item = q.popleft()
        if not q:
            del self.by_len[length]
            self.lens.pop(bisect.bisect_left(self.lens, length))
        self.size -= 1
        return item

    def pop_largest_fitting(self, limit: int):
        i = bisect.bisect_right(self.lens, limit)
        if i == 0:
            return None
        ln = self.lens[i - 1]
        return ln, self._pop(ln)

    def pop_shortest(self):
        ln = self.lens[0]
        return ln, self._pop(ln)


Placed = tuple  # (item, row, offset, take, ...)


class Packer:
    """Documents go in one at a time, placements come out when their row is complete."""

    def __init__(self, cap: int, buffer: int):
        self.cap, self.buffer = cap, buffer
        self.index = _LengthIndex()
        self.row, self.pos = 0, 0
        self.open: list[Placed] = []  # of the row that is being filled

    def _put(self, item, take: int) -> None:
        self.open.append((item, self.row, self.pos, take))
        self.pos += take

    def _close(self) -> list[Placed]:
        done, self.open = self.open, []
        self.row, self.pos = self.row + 1, 0
        return done

    def buffered(self) -> list[tuple[int, object]]:
        """(length, item) of the buffer; added again in this order, they are chosen alike."""
        return [(length, item) for length in self.index.lens for item in self.index.by_len[length]]


class CropPacker(Packer):
    """Best-fit cropping: rows are exactly ``cap`` long.

    Before each placement the buffer is refilled while it holds fewer than ``buffer`` documents,
    one batch of ``batch`` documents at a time.  The largest document that fits the rest of the
    row is placed (earliest among equals); if none fits, the shortest (earliest among equals) is
    cropped to fill the row and its remainder is discarded.
    """

    def __init__(self, cap: int, buffer: int = 1000, batch: int = 128, keep_tail: bool = False):
        super().__init__(cap, buffer)
        self.batch, self.keep_tail = batch, keep_tail
        self.waiting: list[tuple[int, object]] = []  # a batch that isn't complete yet

    def _refill(self) -> None:
        for length, item in self.waiting:
            self.index.add(length, item)
        self.waiting = []

    def _place(self) -> list[Placed]:
        room = self.cap - self.pos
        hit = self.index.pop_largest_fitting(room)
        if hit is not None:
            self._put(hit[1], hit[0])
        else:
            self._put(self.index.pop_shortest()[1], room)
        return self._close() if self.pos == self.cap else []

    def add(self, length: int, item) -> list[Placed]:
        self.waiting.append((length, item))
        out: list[Placed] = []
        if len(self.waiting) == self.batch:
            self._refill()
            while self.index.size >= self.buffer:
                out += self._place()
        return out

    def end(self) -> list[Placed]:
        self._refill()
        out: list[Placed] = []
        while self.index.size:
            out += self._place()
        return out + (self._close() if self.keep_tail else [])


class PadPacker(Packer):
    """Best-fit padding (documents are at most ``cap`` long); placements also tell their row's content.

    The buffer is refilled one document at a time up to ``buffer``.  The largest fitting document
    is placed; when none fits the row is padded and closed, as is the last one.
    """

    def _close(self) -> list[Placed]:
        content = self.pos
        return [(*placed, content) for placed in super()._close()]

    def _place(self) -> list[Placed]:
        hit = self.index.pop_largest_fitting(self.cap - self.pos)
        if hit is None:
            return self._close()
        self._put(hit[1], hit[0])
        return self._close() if self.pos == self.cap else []

    def add(self, length: int, item) -> list[Placed]:
        self.index.add(length, item)
        out: list[Placed] = []
        while self.index.size >= self.buffer:
            out += self._place()
        return out

    def end(self) -> list[Placed]:
        out: list[Placed] = []
        while self.index.size:
            out += self._place()
        return out + (self._close() if self.open else [])


# ----------------------------------------------------------------------------
# First fit decreasing.

def first_fit_runs(histogram: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int, int]]:
    """First-fit decreasing of documents given as {length: number}; lengths are 1 to ``cap``.

    Rows with the same room that follow one another are one run, which equal documents fill alike.
    Returns (length, nth, first, each, row0, fill): of the documents of a length, the nth line
    places those from number ``first`` on, ``each`` to a row, from row ``row0`` on, whose first
    ``fill`` places are taken.  ``nth`` counts from 1.
    """
    runs: list[tuple[int, int, int]] = []  # (first row, rows, room)
    rows = 0
    out = []
    shortest = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        left, first, nth = histogram[length], 0, 0
        new = -(-left // (cap // length))
        after: list[tuple[int, int, int]] = []
        opened = rows
        for row0, number, room in [*runs, (rows, new, cap)]:  # the last are rows that could be opened
            each = room // length
            if left and each:
                whole = min(number, left // each)
                rest = left - whole * each if whole < number else 0
                rest = min(rest, each)
                nth += 1
                out.append((length, nth, first, each, row0, cap - room))
                if whole:
                    after.append((row0, whole, room - each * length))
                if rest:
                    after.append((row0 + whole, 1, room - rest * length))
                left -= whole * each + rest
                first += whole * each + rest
                used = whole + (1 if rest else 0)
                opened = max(opened, row0 + used)
                row0, number = row0 + used, number - used
            if number and row0 < opened:
                after.append((row0, number, room))
        rows = opened
        runs = [r for r in after if r[2] >= shortest]
    return out
