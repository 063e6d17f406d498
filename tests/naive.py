"""Plain models of sharding and packing, one document after the other."""

from __future__ import annotations

import numpy as np


def budget_boundaries(lengths: np.ndarray, budget: int, multiple: int = 1) -> tuple[np.ndarray, int]:
    """Group id per item: a group closes at the first item where its running
    total reaches ``budget`` (the crossing item is included) and, if
    ``multiple`` > 1, its item count is a multiple of ``multiple``.
    Items after the last close get id = number of closed groups (the tail).
    Returns (group ids, number of closed groups).
    """
    n = len(lengths)
    gid = np.empty(n, dtype=np.int64)
    cs = np.cumsum(lengths, dtype=np.int64)
    start, g = 0, 0
    base = 0
    while start < n:
        j = int(np.searchsorted(cs, base + budget, side="left"))
        if j >= n:
            break
        if multiple > 1:
            cnt = j - start + 1
            j = start + -(-cnt // multiple) * multiple - 1
            if j >= n:
                break
        gid[start:j + 1] = g
        base = int(cs[j])
        start, g = j + 1, g + 1
    gid[start:] = g
    return gid, g


def greedy_pad_rows(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """In order; a document that does not fit the rest of the row starts a new row.

    Documents longer than ``cap`` are cropped to ``cap`` in a row of their own.
    Returns (row id, offset) per document.
    """
    n = len(lengths)
    rows = np.empty(n, dtype=np.int64)
    offs = np.empty(n, dtype=np.int64)
    row, pos = 0, 0
    for i in range(n):
        ln = min(int(lengths[i]), cap)
        if pos + ln > cap:
            row, pos = row + 1, 0
        rows[i], offs[i] = row, pos
        pos += ln
        if pos == cap:
            row, pos = row + 1, 0
    return rows, offs


def first_fit_decreasing(lengths: np.ndarray, cap: int):
    """First-fit decreasing; documents longer than ``cap`` are cropped to ``cap``.

    Order: length descending, then input position.  A max segment tree over
    row free space finds the first row with room in O(log rows).
    Returns (row, offset, take) per document in input order.
    """
    n = len(lengths)
    take = np.minimum(lengths.astype(np.int64), cap)
    order = sorted(range(n), key=lambda i: (-int(take[i]), i))
    size = 1
    while size < max(1, n):
        size *= 2
    tree = [0] * (2 * size)  # free space per row; unopened rows hold cap
    for i in range(size):
        tree[size + i] = cap
    for i in range(size - 1, 0, -1):
        tree[i] = max(tree[2 * i], tree[2 * i + 1])
    rows = np.empty(n, dtype=np.int64)
    offs = np.empty(n, dtype=np.int64)
    for i in order:
        need = int(take[i])
        node = 1
        while node < size:
            node = 2 * node if tree[2 * node] >= need else 2 * node + 1
        r = node - size
        rows[i], offs[i] = r, cap - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
    return rows, offs, take
