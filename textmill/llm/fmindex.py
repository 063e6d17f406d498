"""FM-index over a sequence of small integers, in numpy: all searches run side by side.

Built by the tasks of ``decontamination`` for one shard of text at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in sorted order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n and rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1  # a suffix that ends sorts first
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        width *= 2
    return order


class Wavelet:
    """Wavelet matrix: how often a symbol occurs before a position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the first ``at`` entries."""
        lo, hi = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Backward search over ``text``: symbols 2 and up; 1 separates, 0 is the end put here."""

    STEP = 8  # every so many text positions have their place in the suffix order kept

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]  # the last symbol comes before the first
        self.wavelet = Wavelet(self.bwt, max(1, int(symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.kept = order % self.STEP == 0
        self.at = np.where(self.kept, order, -1)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that start with each phrase; phrases are right-aligned."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, width - k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: walk back to a kept one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.kept[rows[open_]]
            done = open_[here]
            out[done] = self.at[rows[done]] + steps[done]
            open_ = open_[~here]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.wavelet.rank(c, rows[open_])
            steps[open_] += 1
        return out

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence."""
        lo, hi = self.ranges(phrases, lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(phrases)), count)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return which, self.locate(rows)
