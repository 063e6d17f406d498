"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is wanted ``target / source_size`` times: the whole part is taken as
it is, the fractional part is rounded.  Pivotal rounding pairs two documents with fractional
parts and moves mass between them, measured in words, in a random direction until one of them
is whole; the words wanted of the pair stay the same, and so do both expectations.  Documents
are dealt into chunks of about ``chunk_rows`` rows of one source; each chunk leaves at most
one fractional document, and these residuals meet ``FAN_IN`` chunks at a time in a reduction
tree, until one document of the source remains, which is drawn alone.  Large documents pair
first, so this is mostly a small one.  A source's taken words miss its target by less than it.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ... of all words; a target
stops at ``max_copies`` times the source's size and the excess is shared again by weight.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source;
repeated rows are rounded each for itself; an empty table gives an empty result; other
columns are ignored (``mixed`` returns them), whatever their names, but ``mixed`` replaces a
column ``copy_no``.
"""

from __future__ import annotations

import math
import zlib
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, as_rows, cut, dense_sorted_index, table

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CHUNK_ROWS = 20_000
FAN_IN = 256
SEED = 42
EPS = 1e-9
ITEM = "i string, h long, n int, source string, size long, whole int, part double, chunk long"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(items: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size): one row per source."""
    per = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = dense_sorted_index(per, F.col("source").asc_nulls_last(), name="sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", (F.col("source_size") * max_copies).cast("double"))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rate, held = 0.0, -1
    while True:  # each round holds at least one more source at its cap
        capped = F.col("most") <= F.lit(rate) * F.col("w")
        got = per.agg(F.sum(F.when(capped, 1).otherwise(0)), F.sum(F.when(capped, F.col("most"))),
                      F.sum(F.when(~capped, F.col("w")))).first()
        if got[0] is None or got[0] == held or not got[2]:
            break
        held, rate = got[0], max(rate, (total - (got[1] or 0.0)) / got[2])
    target = F.least(F.col("most"), F.lit(rate) * F.col("w"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _pivotal(size: np.ndarray, part: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round ``part`` in place; one entry stays fractional, unless ``last``."""
    whole = lambda p: 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
    draws = rng.random(len(part))
    hold = -1
    for j in range(len(part)):
        if part[j] <= 0.0 or part[j] >= 1.0:
            continue
        if size[j] == 0:
            part[j] = float(draws[j] < part[j])
            continue
        if hold < 0:
            hold = j
            continue
        a, b = hold, j
        sa, sb, pa, pb = float(size[a]), float(size[b]), part[a], part[b]
        up = min((1 - pa) * sa, pb * sb)  # words that may go from b to a
        down = min(pa * sa, (1 - pb) * sb)  # and from a to b
        move = up if draws[j] * (up + down) < down else -down
        part[a], part[b] = whole(pa + move / sa), whole(pb - move / sb)
        hold = a if 0.0 < part[a] < 1.0 else b if 0.0 < part[b] < 1.0 else -1
    if last and hold >= 0:
        part[hold] = float(rng.random() < part[hold])
    return part


def _rounder(level: int, last: bool, seed: int):
    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that the one left over is a small one
        rows = rows.sort_values(["size", "i", "h", "n"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng(zlib.crc32(repr((seed, level, key[0], int(key[1]))).encode()))
        return rows.assign(part=_pivotal(rows["size"].to_numpy(), rows["part"].to_numpy(copy=True), rng, last), chunk=int(key[1]))
    return run


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights=WEIGHTS, max_copies: int = MAX_COPIES, chunk_rows: int = CHUNK_ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: i, h, n (its key), source, size, source_size, target, copies."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(source_col).alias("source"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), word_count(text).alias("size"))
    items = cut(rows, "mix-items")
    targets = cut(source_targets(items, weights, max_copies), "mix-targets")
    # spread of keys that repeat: rows of one key are told apart by their number
    nth = F.row_number().over(Window.partitionBy("i", "h", "source").orderBy("size"))
    t = targets.select(F.col("source").alias("s"), "n_docs", (F.col("target") / F.greatest("source_size", F.lit(1))).alias("rate"))
    chunk = F.pmod(F.xxhash64("i", "h", "n"), F.ceil(F.col("n_docs") / chunk_rows))
    part = F.col("rate") - F.floor("rate")
    dealt = (items.withColumn("n", nth).join(t, F.col("source").eqNullSafe(F.col("s")))
             .select("i", "h", "n", "source", "size", (F.floor("rate") + F.when(part > 1 - EPS, 1).otherwise(0)).cast("int").alias("whole"),
                     F.when((part < EPS) | (part > 1 - EPS), 0.0).otherwise(part).alias("part"), chunk.alias("chunk")))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(1, math.ceil(most / chunk_rows)), FAN_IN))) + 1
    settled, state = [], dealt
    for level in range(levels):
        last = level == levels - 1
        if level:
            state = state.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        state = cut(state.groupBy("source", "chunk").applyInPandas(_rounder(level, last, seed), ITEM), "mix-round")
        left = (F.col("part") > 0) & (F.col("part") < 1)
        settled.append(state.filter(~left))
        state = state.filter(left)
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return (done.join(t, F.col("source").eqNullSafe(F.col("s")))
            .select("i", "h", "n", "source", "size", "source_size", "target", (F.col("whole") + F.col("part").cast("int")).alias("copies")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with ``copy_no`` from 1."""
    got = decisions(docs, id_col, text_col, source_col, **how).filter("copies > 0")
    got = got.select("i", "h", "source", "n", "copies")
    row = F.col("row")
    mine = as_rows(docs).select("row", row[id_col].cast("string").alias("id"), F.xxhash64(F.coalesce(row[text_col], F.lit(""))).alias("x"), row[source_col].alias("s"))
    mine = mine.withColumn("k", F.row_number().over(Window.partitionBy("id", "x", "s").orderBy(F.lit(1))))
    on = (F.col("id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("h")) & F.col("s").eqNullSafe(F.col("source"))
          & (F.col("k") == F.col("n")))
    out = mine.join(got, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("times"))
    return out.select(*[row[c].alias(c) for c in docs.columns if c != "copy_no"], F.col("times").alias("copy_no"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decisions(table(spark, sf_dir, "documents"))
    return got.select(F.col("i").cast("long").alias("doc_id"), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
