"""Source mixing, seeded permutations, epochs and task mixtures.

Every random choice is an md5 draw (``functions.hashing``) so results are
identical across engines and independent of partitioning.  Ranks use the
skew-safe prefix sums of ``functions.ranking``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32, order_cols
from ..functions.identity import NTH, SAME, numbered, with_lines
from ..functions.ranking import count_not_above, dense_index
from ..functions.sizing import broadcast_if_small
from ..session import materialised

H60 = (0, 1 << 60)  # the first order key of a seeded permutation is spread over this range
MAX_LIVE = 1 << 30


def seeded_shuffle(df: DataFrame, seed: int, keys: Sequence[str], out: str = "shuffle_idx") -> DataFrame:
    """Full permutation: dense index in order ``md5(seed|keys)``, ties by the keys."""
    oc = order_cols(seed, keys)
    tmp = df.withColumn("_h60", oc[0]).withColumn("_md5", oc[1])
    res = dense_index(tmp, ["_h60", "_md5", *keys], out=out, dense=H60)
    return res.drop("_h60", "_md5")


def _live_spec(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """Spec rows with at least one document, with cumulative weights in spec order."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    live = broadcast_if_small(spec).join(counts, "source")
    w_all = Window.partitionBy()  # one row per source of the spec
    w_cum = Window.orderBy("spec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (live.withColumn("w_hi", F.sum(F.col("weight").cast("double")).over(w_cum))
            .withColumn("w_tot", F.sum(F.col("weight").cast("double")).over(w_all))
            .withColumn("w_lo", F.col("w_hi") - F.col("weight").cast("double"))
            .withColumn("first_idx", F.min("spec_idx").over(w_all)))


def weighted_interleave(docs: DataFrame, spec: DataFrame, n_draws: int, seed: int = 42,
                        key: str = "doc_id") -> DataFrame:
    """Weighted draws over sources; each source replays itself in a new order per epoch.

    docs: ``(source, key, ...)``; spec: ``(source, weight, spec_idx)``.
    Draw ``d`` takes ``u = md5(seed|d)`` and picks the first live source (spec
    order) with ``u*W <= cumulative weight``.  Its rank ``k`` among that source's
    draws gives ``epoch = k div n`` and ``pos = k mod n``; the document is the
    ``pos``-th of the epoch's permutation ``md5(seed|source|epoch|key)``.
    """
    spark = docs.sparkSession
    keys = materialised(numbered(docs, ["source", key], {}), "mix-keys")  # read by the count and by every epoch
    entry = F.struct("spec_idx", "w_hi", "source", "n_docs")
    live = _live_spec(keys, spec).agg(F.array_sort(F.collect_list(entry)).alias("_live"), F.max("w_tot").alias("_w"))
    live = live.withColumn("_hi", F.transform("_live", lambda e: -e["w_hi"])).withColumn("_hi", F.reverse("_hi"))
    u = hash32(seed, "d") / F.lit(4294967296.0) * F.col("_w")
    # entries whose cumulative weight is at least u, counted from the end
    at = F.size("_live") - count_not_above(F.col("_hi"), -u, MAX_LIVE)
    draws = spark.range(n_draws).withColumnRenamed("id", "d").crossJoin(F.broadcast(live))  # one row
    picked = draws.withColumn("_e", F.get("_live", at)).select("d", "_e.source", "_e.n_docs").filter("source is not null")
    ranked = dense_index(picked, ["d"], by=["source"], out="k", dense=(0, n_draws))
    ranked = ranked.withColumn("epoch", F.floor(F.col("k") / F.col("n_docs"))) \
                   .withColumn("pos", F.col("k") % F.col("n_docs"))
    max_epoch = ranked.groupBy("source").agg(F.max("epoch").alias("_me"))
    perm = (keys.join(F.broadcast(max_epoch), "source")  # one row per live source
            .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_me"))))
            .drop("_me"))
    oc = order_cols(seed, [key], F.col("source"), F.col("epoch"))
    perm = perm.withColumn("_h60", oc[0]).withColumn("_md5", oc[1])
    perm = dense_index(perm, ["_h60", "_md5", key, *SAME, NTH], by=["source", "epoch"], out="pos", dense=H60).drop("_h60", "_md5")
    drawn = ranked.drop("n_docs").join(perm, ["source", "epoch", "pos"])
    return with_lines(docs, drawn, ["source", key])  # keys are ranked; documents come last


def mix_realized(mixed: DataFrame, spec: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per source: draws, distinct docs, chars, epochs used, realised vs target share."""
    live = _live_spec(docs, spec).select("source", "weight", "w_tot", "n_docs")
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.count_distinct(key).alias("n_unique_docs"),
        F.sum("n_chars").alias("n_chars"),
        (F.max("epoch") + 1).alias("n_epochs"))
    total = Window.partitionBy()  # one row per source
    return (per.join(F.broadcast(live), "source")
            .select("source", "n_draws", "n_unique_docs", "n_chars", "n_epochs",
                    F.round(F.col("n_draws") / F.col("n_docs"), 6).alias("epochs_used"),
                    F.round(F.col("n_draws") / F.sum("n_draws").over(total), 6).alias("share"),
                    F.round(F.col("weight") / F.col("w_tot"), 6).alias("target_share")))


def epoch_repeat(df: DataFrame, epochs: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Repeat ``df`` for ``epochs`` epochs, each a fresh permutation (within ``by``).

    Pass the keys only where rows are wide, and join the rest to the result.
    """
    rep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    oc = order_cols(seed, [key], *[F.col(b) for b in by], F.col("epoch"))
    rep = rep.withColumn("_h60", oc[0]).withColumn("_md5", oc[1])
    return dense_index(rep, ["_h60", "_md5", key], by=[*by, "epoch"], out="pos", dense=H60).drop("_h60", "_md5")


def task_mixture(parts: Sequence[DataFrame], seed: int = 42, local_idx: str = "local_idx") -> DataFrame:
    """Union all parts (a part given k times counts k times) and permute all rows.

    Each part must carry a dense ``local_idx``; output adds ``task_idx`` and ``idx``.
    """
    tagged = [p.withColumn("task_idx", F.lit(i)) for i, p in enumerate(parts)]
    allp = tagged[0]
    for t in tagged[1:]:
        allp = allp.unionByName(t, allowMissingColumns=True)
    oc = order_cols(seed, ["task_idx", local_idx])
    allp = allp.withColumn("_h60", oc[0]).withColumn("_md5", oc[1])
    return dense_index(allp, ["_h60", "_md5", "task_idx", local_idx], out="idx", dense=H60).drop("_h60", "_md5")


def task_sequence(parts: Sequence[DataFrame], local_idx: str = "local_idx") -> DataFrame:
    """Ordered concatenation: ``idx = (sum of earlier part lengths) + local_idx``."""
    tagged = [p.withColumn("task_idx", F.lit(i)) for i, p in enumerate(parts)]
    allp = tagged[0]
    for t in tagged[1:]:
        allp = allp.unionByName(t, allowMissingColumns=True)
    lengths = allp.groupBy("task_idx").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("task_idx").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offs = lengths.select("task_idx", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return allp.join(F.broadcast(offs), "task_idx").withColumn(
        "idx", F.col("_off") + F.col(local_idx)).drop("_off")


def slice_view(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1,
               idx: str = "idx") -> DataFrame:
    """Logical ``[start:stop:step]`` over a dense index; output re-indexed from 0."""
    cond = (F.col(idx) >= start) & (((F.col(idx) - start) % step) == 0)
    if stop is not None:
        cond = cond & (F.col(idx) < stop)
    return df.filter(cond).withColumn("view_idx", ((F.col(idx) - start) / step).cast("long"))


def val_head(df: DataFrame, n: int = 500, idx: str = "idx", disjoint: bool = True):
    """Validation = first ``n`` rows. ``disjoint=False`` keeps them in train too (compat)."""
    val = df.filter(F.col(idx) < n)
    train = df.filter(F.col(idx) >= n) if disjoint else df
    return train, val


def limit_per_task(df: DataFrame, n: int, task: str, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows of every task in ``order``; ``n=0`` keeps all."""
    if n <= 0:
        return df
    ranked = dense_index(df, list(order), by=[task], out="_rn")
    return ranked.filter(F.col("_rn") < n).drop("_rn")
