"""Hard negatives of anchor vectors, by Strassen products of integer tiles and mergeable heaps.

Components become integers, ``floor(SCALE * x)``, so that scores are exact.  Rows are put in
the order of their labels and cut into blocks; so are the anchors.  Two passes go over tiles
of one block of anchors and one of rows:

1. Blocks that share a label: the product of the tile gives the scores, and each anchor keeps
   its best rows of its own label in a heap of ``POSITIVES`` entries.
2. Blocks that hold different labels: a heap of ``NEGATIVES`` entries for each anchor and
   positive keeps the best rows of other labels whose score lies in the positive's window.

A tile is multiplied by Strassen's recursion: odd sides get a row or column of zeros, seven
products of half the size replace eight, and all sums are of int64.  These wrap, and the
recursion holds in any ring, so every score that fits 64 bits is exact.  Heaps of the tiles of
an anchor merge into one by taking the first entries of all, in Spark.  A tile has a bounded
size whatever the number of rows with one label, and blocks of a single label meet in one of
the two passes only.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take
no part; an empty vector does, with scores of 0, and of vectors of different lengths the
shorter ends in zeros; a null id isn't an anchor and comes last among equal scores; every one
of repeated rows counts, and a repeat of an anchor is another row; components beyond 64 bits
become the nearest 64-bit integer, and scores beyond them wrap; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, dense_sorted_index, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
PART = 5  # a negative's score lacks at most one part in so many of the positive's
ANCHOR_BLOCK = 2048
BLOCK = 8192
TILE = 512  # anchors, and a fourth of the rows, that are multiplied at once
LEAF = 16
LAST = (1 << 63) - 1  # stands for a null id
LOW = -(1 << 63)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices (modulo 2**64)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= LEAF:
        return np.einsum("ik,jk->ij", a, np.ascontiguousarray(b.T)) if k else np.zeros((m, n), np.int64)
    a = np.pad(a, ((0, m & 1), (0, k & 1)))
    b = np.pad(b, ((0, k & 1), (0, n & 1)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * x, 2 * z), np.int64)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of ``rows`` owners the ``size`` entries of largest score, ties by smaller id."""

    def __init__(self, rows: int, size: int):
        self.size = size
        self.score = np.full((rows, size), LOW, np.int64)
        self.id = np.full((rows, size), LAST, np.int64)
        self.at = np.full((rows, size), -1, np.int64)  # -1: no entry

    def offer(self, first: int, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Scores of the owners from ``first`` on (lines) with other rows (columns)."""
        own = slice(first, first + len(score))
        full = (self.at[own, -1] >= 0)[:, None]
        floor, floor_id = self.score[own, -1][:, None], self.id[own, -1][:, None]
        take = allowed & (~full | (score > floor) | ((score == floor) & (ids[None, :] < floor_id)))
        if take.sum() > 16 * self.size * len(score) and score.shape[1] > self.size:
            best = np.partition(np.where(take, score, LOW), score.shape[1] - self.size, axis=1)
            take &= score >= best[:, score.shape[1] - self.size][:, None]
        i, j = np.nonzero(take)
        if not len(i):
            return
        old_i, old_j = np.nonzero(self.at[own] >= 0)
        row = np.concatenate([old_i, i])
        s = np.concatenate([self.score[own][old_i, old_j], score[i, j]])
        d = np.concatenate([self.id[own][old_i, old_j], ids[j]])
        a = np.concatenate([self.at[own][old_i, old_j], at[j]])
        order = np.lexsort((a, d, ~s, row))
        row, s, d, a = row[order], s[order], d[order], a[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate([start, [len(row)]])))
        row, s, d, a, nth = (x[nth < self.size] for x in (row, s, d, a, nth))
        self.score[first + row, nth], self.id[first + row, nth], self.at[first + row, nth] = s, d, a

    def entries(self) -> tuple[np.ndarray, ...]:
        """(owner, score, id, at) of all entries."""
        i, j = np.nonzero(self.at >= 0)
        return i, self.score[i, j], self.id[i, j], self.at[i, j]


def _packed(rows: pa.Table) -> pa.Table:
    """A block as one row: ids, labels, ranks, and vectors with as few bytes a component as fit."""
    order = np.argsort(rows.column("rank").to_numpy(), kind="stable")
    vectors = rows.column("v").combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    dim = int(sizes.max(initial=0))
    matrix = np.zeros((len(sizes), dim), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not matrix.size or (-(1 << 8 * w - 1) <= matrix.min() and matrix.max() < 1 << 8 * w - 1))
    label = rows.column("label").to_numpy()[order]
    pack = lambda x: pa.array([x.tobytes()], pa.binary())
    whole = lambda x: pa.array([int(x)], pa.int64())
    return pa.table({"block": whole(rows.column("block")[0].as_py()), "lo": whole(label[0]), "hi": whole(label[-1]), "dim": whole(dim), "width": whole(width),
                     "ids": pack(rows.column("i").to_numpy()[order]), "labels": pack(label), "ranks": pack(rows.column("rank").to_numpy()[order]),
                     "vectors": pack(matrix[order].astype(f"<i{width}"))})


PACKED = "block long, lo long, hi long, dim long, width long, ids binary, labels binary, ranks binary, vectors binary"


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Packed blocks of rows with ``size`` consecutive places in the order of labels."""
    block = F.expr(f"place div {size}").alias("block")
    return cut(rows.select(block, "i", "label", "rank", "v").groupBy("block").applyInArrow(_packed, PACKED), name)


def _unpacked(block: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, labels, ranks, vectors) of a packed block."""
    ids, labels, ranks = (np.frombuffer(block.column(c)[0].as_py(), np.int64) for c in ("ids", "labels", "ranks"))
    dim, width = block.column("dim")[0].as_py(), block.column("width")[0].as_py()
    return ids, labels, ranks, np.frombuffer(block.column("vectors")[0].as_py(), f"<i{width}").reshape(len(ids), dim).astype(np.int64)


def _products(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first anchor, first row, scores) of each part of a tile."""
    dim = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (anchors, rows))
    for c in range(0, len(rows), 4 * TILE):
        side = np.ascontiguousarray(rows[c:c + 4 * TILE].T)
        for a in range(0, len(anchors), TILE):
            yield a, c, strassen(anchors[a:a + TILE], side)


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    """(anchor, score, i, at): the best rows of each anchor's label within a tile."""
    _, a_label, a_rank, a = _unpacked(left)
    ids, label, rank, v = _unpacked(right)
    heaps = Heaps(len(a), POSITIVES)
    for x, y, score in _products(a, v):
        other = slice(y, y + score.shape[1])
        allowed = (a_label[x:x + len(score), None] == label[None, other]) & (a_rank[x:x + len(score), None] != rank[None, other])
        heaps.offer(x, score, allowed, ids[other], rank[other])
    i, score, near, at = heaps.entries()
    return pa.table({"anchor": a_rank[i], "score": score, "i": near, "at": at})


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    """(anchor, nth, score, i, at): the best rows of other labels in each positive's window within a tile."""
    _, a_label, a_rank, a = _unpacked(left)
    ids, label, rank, v = _unpacked(right)
    window = np.zeros((len(a), POSITIVES), np.int64)
    has = np.zeros((len(a), POSITIVES), bool)
    for p in left.column("positives")[0].as_py():
        k = np.searchsorted(a_rank, p["anchor"])
        window[k, p["nth"]], has[k, p["nth"]] = p["score"], True
    least = window - window // PART  # 80 * p <= 100 * n, without a product that could wrap
    heaps = [Heaps(len(a), NEGATIVES) for _ in range(POSITIVES)]
    for x, y, score in _products(a, v):
        own, other = slice(x, x + len(score)), slice(y, y + score.shape[1])
        different = a_label[own, None] != label[None, other]
        for k in range(POSITIVES):
            allowed = different & has[own, k, None] & (score <= window[own, k, None]) & (score >= least[own, k, None])
            heaps[k].offer(x, score, allowed, ids[other], rank[other])
    found = [h.entries() for h in heaps]
    join = lambda n: np.concatenate([f[n] for f in found])
    return pa.table({"anchor": a_rank[join(0)], "of": np.repeat(np.arange(POSITIVES), [len(f[0]) for f in found]), "score": join(1), "i": join(2), "at": join(3)})


def _best(entries: DataFrame, size: int, *owner: str) -> DataFrame:
    """The heaps of all tiles of an owner merged; ``nth`` counts from 0."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), "i", "at")
    return entries.withColumn("nth", F.row_number().over(order) - 1).filter(F.col("nth") < size)


def _tiles(anchors: DataFrame, blocks: DataFrame, wanted, run, schema: str) -> DataFrame:
    """``run`` on each pair of a block of anchors and one of rows whose labels are ``wanted``."""
    spans = blocks.select(F.col("block").alias("c"), "lo", "hi")
    number = spans.count()
    pairs = (anchors.select(F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.expr(f"explode(sequence(0L, {number - 1}L))").alias("c"))
             .join(spans, "c").filter(wanted).select("a", "c"))
    left = anchors.join(pairs, F.col("block") == F.col("a")).drop("block")
    right = blocks.join(pairs.select(F.col("a").alias("ra"), F.col("c").alias("rc")), F.col("block") == F.col("rc")).drop("block")
    return left.groupBy("a", "c").cogroup(right.groupBy("ra", "rc")).applyInArrow(run, schema)


def scored_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(i, label, v): the rows that take part, with integer components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    kept = vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return kept.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("i"), F.col(label_col).cast("long").alias("label"),
                       F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """One row per anchor, positive and negative: ids, ranks from 1 and scores.

    ``rows`` are of ``scored_rows``; ``is_anchor`` is a condition on ``i``.
    """
    numbered = rows.withColumn("u", F.monotonically_increasing_id())  # spreads a hot label
    ranked = cut(dense_sorted_index(numbered, F.col("label"), F.col("u"), name="negatives-order"), "negatives-rows")
    chosen = ranked.filter((F.col("i") != LAST) & is_anchor).withColumnRenamed("rank", "row")
    chosen = cut(dense_sorted_index(chosen, F.col("row"), name="negatives-anchors").withColumnRenamed("rank", "place"), "negatives-chosen")
    anchors = _blocks(chosen.withColumnRenamed("row", "rank"), ANCHOR_BLOCK, "negatives-anchor-blocks")
    blocks = _blocks(ranked.withColumn("place", F.col("rank")), BLOCK, "negatives-blocks")

    shared = (F.col("a_lo") <= F.col("hi")) & (F.col("lo") <= F.col("a_hi"))
    found = _tiles(anchors, blocks, shared, _positives, "anchor long, score long, i long, at long")
    positives = cut(_best(found, POSITIVES, "anchor").withColumn("nth", F.col("nth").cast("long")), "negatives-positives")

    one_label = (F.col("a_lo") == F.col("a_hi")) & (F.col("lo") == F.col("hi")) & (F.col("a_lo") == F.col("lo"))
    lists = (positives.join(chosen.select(F.expr(f"place div {ANCHOR_BLOCK}").alias("block"), F.col("row").alias("anchor")), "anchor")
             .groupBy("block").agg(F.collect_list(F.struct("anchor", "nth", "score")).alias("positives")))  # of one block
    found = _tiles(anchors.join(lists, "block"), blocks, ~one_label, _negatives, "anchor long, of long, score long, i long, at long")
    negatives = _best(found, NEGATIVES, "anchor", "of").select(
        "anchor", "of", (F.col("nth") + 1).alias("rank"), F.col("i").alias("n"), F.col("score").alias("negative_score"))
    positives = positives.select("anchor", F.col("nth").alias("of"), F.col("i").alias("p"), F.col("score").alias("positive_score"))
    ids = chosen.select(F.col("row").alias("anchor"), F.col("i").alias("anchor_id"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return negatives.join(positives, ["anchor", "of"]).join(ids, "anchor").select(
        "anchor_id", real("p").alias("positive_id"), (F.col("of") + 1).cast("int").alias("positive_rank"), "rank", real("n").alias("negative_id"),
        "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_rows(table(spark, sf_dir, "embeddings"))
    moved = F.when((F.col("i") != LAST) & (F.col("i") % 7 == 0), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mined(rows.withColumn("label", moved), F.col("i") % 100 == 0)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s
  ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
