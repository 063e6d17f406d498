"""Hard negatives: Strassen products, heaps and whole results against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, i string, rank string, place int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 7), (33, 17, 40), (65, 64, 130), (70, 33, 18), (20, 0, 20)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(sum(shape))
    for top in (100, 1 << 62):  # the second wraps
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (H.strassen(a, b) == a @ b).all()


def test_heaps_keep_the_best():
    rng = np.random.default_rng(1)
    heaps = H.Heaps(4, 3)
    score, ids = rng.integers(0, 6, (4, 400)), rng.permutation(400).astype(np.int64)
    allowed = rng.random((4, 400)) < 0.7
    for lo in range(0, 400, 100):
        heaps.offer(0, score[:, lo:lo + 100], allowed[:, lo:lo + 100], ids[lo:lo + 100], np.arange(lo, lo + 100))
    for r in range(4):
        want = sorted((-score[r, j], ids[j]) for j in range(400) if allowed[r, j])[:3]
        assert [(-s, d) for s, d in zip(heaps.score[r], heaps.id[r], strict=True)] == want


def brute(rows, anchors_are):
    """The contract, row by row, on (id, vector, label); a null id comes last."""
    def product(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    last = 1 << 63
    for k, (i, v, label) in enumerate(kept):
        if i is None or not anchors_are(i):
            continue
        others = sorted(((-product(v, w), last if j is None else j, m == label) for n, (j, w, m) in enumerate(kept) if n != k))
        for p, (s, j, _) in enumerate([x for x in others if x[2]][:5]):
            inside = [(t, n) for t, n, same in others if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, None if j == last else j, p + 1, r + 1, None if n == last else n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out, key=str)


def mine(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in H.mined(H.scored_rows(frame), F.col("i") % 10 == 0).collect()), key=str)


@pytest.mark.parametrize("blocks", [(2048, 8192), (4, 16)])
def test_mined(spark, monkeypatch, blocks):
    """Small blocks give the same as one block; a third of the rows has one label and one vector."""
    for name, value in zip(("ANCHOR_BLOCK", "BLOCK"), blocks, strict=True):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(7)
    rows = [(i, [0.5, 0.25, 0.125, -0.5], 1) if i % 3 == 0 else (i, [float(x) for x in rng.integers(-8, 9, 4) / 16], int(rng.integers(0, 4))) for i in range(150)]
    rows += [(None, [0.5] * 4, 1), (None, [0.25] * 4, 2), (20, [0.5] * 4, 1), (20, [0.5] * 4, 1), (30, [0.5, 0.5], 2), (40, [], 0),
             (50, None, 1), (60, [1.0] * 4, None), (70, [1.0, None, 0.0, 0.0], 1), (80, [math.nan] * 4, 1), (90, [math.inf, 0.0, 0.0, 0.0], 2)]
    assert mine(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_and_large(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(1, [1.0], 1)]) == []
    # a component beyond 64 bits: the scores wrap to -256, whose window is empty
    assert mine(spark, [(10, [1e30], 1), (1, [1.0], 1), (2, [1.0], 2)]) == []
