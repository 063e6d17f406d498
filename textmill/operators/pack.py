"""Sharding and sequence packing: plan on lengths, then assemble tokens.

Lanes replace data-parallel ranks: a lane is ``md5(seed|key) mod n_lanes``,
so a hot source or shard spreads over all lanes, and results are defined per
lane (the lane count is part of the contract).  Plans are made of narrow rows:
cuts by budget and greedy packing by ``boundaries``, first-fit decreasing on the
histogram of lengths, and best fit by streaming a lane's sorted rows past a
bounded buffer, so no lane has to fit a task.  Token arrays are joined to the
plan afterwards and each packed row (at most T+1 tokens) is assembled by a
bounded ``collect_list``.

Keys can be of any type.  Where they repeat or are NULL, rows are told apart by
their other columns; a NULL length is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions.hashing import hash32
from ..functions.identity import NTH, SAME, numbered, with_lines
from ..functions.ranking import running_sum
from ..functions.sizing import broadcast_if_small
from ..session import materialised
from . import kernels
from .boundaries import budget_successors, grouped, pad_successors, prefixed

LANE_BUDGET = 50_000_000  # tokens or characters of a lane: what one planning task sees


def lane_of(key: str, n_lanes: int, seed: int = 42) -> Column:
    return (hash32(seed, key) % F.lit(n_lanes)).cast("int")


def lanes_for(d: DataFrame, length: str, lane_budget: int = LANE_BUDGET) -> int:
    """As many lanes as the data fills; part of the result, since rows are defined per lane."""
    total = d.agg(F.sum(F.col(length).cast("long"))).first()[0] or 0
    return max(1, -(-total // lane_budget))


ORDER = ["key", *SAME, NTH]


def numbered_rows(d: DataFrame, key: str, length: str) -> DataFrame:
    """(key, _h1, _h2, _nth, len) of each row; ``ORDER`` is a total order."""
    size = F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    return numbered(d, [key], {"len": size}).withColumnRenamed(key, "key")


def lane_rows(d: DataFrame, key: str, length: str, n_lanes: int | None, seed: int) -> DataFrame:
    n_lanes = n_lanes or lanes_for(d, length)
    return numbered_rows(d, key, length).withColumn("lane", lane_of("key", n_lanes, seed))


def with_plan(d: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Each line of a plan of ``d`` with its row."""
    return with_lines(d, plan.withColumnRenamed("key", key), [key])


def _most(items: DataFrame, unit: int) -> int:
    """A bound on the groups of a lane that hold at least ``unit``."""
    return int((items.agg(F.max("c")).first()[0] or 0) // max(1, unit) + 2)


# ---------------------------------------------------------------------------
# Shards

def shard_by_budget(d: DataFrame, budget: int, key: str = "doc_id", length: str = "n_chars",
                    n_lanes: int | None = None, seed: int = 42, keep_tail: float | None = 0.5,
                    multiple: int = 1) -> DataFrame:
    """Close a shard when its characters reach ``budget`` (crossing doc included).

    ``multiple`` > 1 additionally requires the shard's doc count to be a
    multiple of it (row-group aligned shards).  The tail is kept when its
    characters are at least ``keep_tail * budget``; ``keep_tail=None`` drops it.
    Returns ``d`` with ``lane`` and ``shard`` (per lane) for kept documents.
    """
    items = prefixed(lane_rows(d, key, length, n_lanes, seed), ORDER)
    got = grouped(items, budget_successors(items, budget, multiple), _most(items, budget))
    kept = F.col("closed")
    if keep_tail is not None:
        whole = items.groupBy("lane").agg(F.max("c").alias("_all")).withColumnRenamed("lane", "_l")
        got = got.join(whole, F.col("lane") == F.col("_l")).drop("_l")
        kept = kept | (F.col("_all") - F.col("base") >= F.lit(keep_tail * budget))
    plan = got.filter(kept).select("key", *SAME, "lane", F.col("group").alias("shard"))
    return with_plan(d, plan, key)


# ---------------------------------------------------------------------------
# Packing plans

def _streamed(rows: DataFrame, packer: Callable[[], kernels.Packer], with_content: bool) -> DataFrame:
    """The plan of a packer for each lane: sorted rows stream past it, and it holds its buffer only."""
    key = rows.schema["key"].dataType
    names = ["lane", "key", *SAME, "row", "offset", "take", "content_len"][:None if with_content else -1]
    schema = T_.StructType([T_.StructField(n, T_.IntegerType() if n == "lane" else key if n == "key" else T_.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, own, types = None, None, None

        def lines(placed):
            if placed:
                cols = zip(*((lane, *item, *rest)[:len(names)] for item, *rest in placed), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("key").type
            types = [pa.int32() if n == "lane" else kind if n == "key" else pa.int64() for n in names]
            placed: list = []
            for at, size, *item in zip(*(batch.column(c).to_pylist() for c in ("lane", "len", "key", *SAME)), strict=True):
                if at != lane:
                    if own is not None:
                        placed += own.end()
                    yield from lines(placed)
                    lane, own, placed = at, packer(), []
                placed += own.add(size, item)
            yield from lines(placed)
        if own is not None:
            yield from lines(own.end())

    return rows.repartition("lane").sortWithinPartitions("lane", *ORDER).mapInArrow(run, schema)


def plan_bestfit_crop(d: DataFrame, T: int, key: str, length: str, n_lanes: int | None = None, seed: int = 42,
                      buffer: int = 1000, batch: int = 128, keep_tail: bool = False) -> DataFrame:
    """Full rows of the longest documents of a buffer that fit, the shortest cropped where none does; empty ones aren't placed."""
    rows = lane_rows(d, key, length, n_lanes, seed).filter(F.col("len") > 0)
    return _streamed(rows, lambda: kernels.CropPacker(T + 1, buffer, batch, keep_tail), False)


def plan_bestfit_pad(d: DataFrame, T: int, key: str, length: str, n_lanes: int | None = None, seed: int = 42,
                     buffer: int = 100) -> DataFrame:
    """Plan plus ``content_len`` of each row; documents are cut to T+1 tokens, empty ones aren't placed."""
    cap = T + 1
    rows = lane_rows(d, key, length, n_lanes, seed).filter(F.col("len") > 0)
    rows = rows.withColumn("len", F.least(F.col("len"), F.lit(cap).cast("long")))
    return _streamed(rows, lambda: kernels.PadPacker(cap, buffer), True)


def plan_greedy_crop(d: DataFrame, T: int, key: str, length: str, n_lanes: int | None = None, seed: int = 42,
                     keep_tail: bool = False) -> DataFrame:
    """Docs in order; the one that overflows is cropped; the incomplete last row only with ``keep_tail``."""
    cap = T + 1
    items = prefixed(lane_rows(d, key, length, n_lanes, seed), ORDER)
    got = grouped(items, budget_successors(items, cap), _most(items, cap))
    before = F.col("p") - F.col("base")
    return got.filter(F.col("closed") | F.lit(keep_tail)).select(
        "lane", "key", *SAME, F.col("group").alias("row"), before.alias("offset"), F.least(F.col("len"), F.lit(cap) - before).alias("take"))


def plan_greedy_pad(d: DataFrame, T: int, key: str, length: str, n_lanes: int | None = None, seed: int = 42) -> DataFrame:
    """In order; a document that doesn't fit the rest of the row starts a new one; longer ones are cropped to a row."""
    cap = T + 1
    rows = lane_rows(d, key, length, n_lanes, seed).withColumn("len", F.least(F.col("len"), F.lit(cap).cast("long")))
    items = prefixed(rows, ORDER)
    got = grouped(items, pad_successors(items, cap), _most(items, cap // 2))  # two neighbours hold more than cap
    return got.select("lane", "key", *SAME, F.col("group").alias("row"), (F.col("p") - F.col("base")).alias("offset"), F.col("len").alias("take"))


def plan_ffd(d: DataFrame, T: int, key: str, length: str, n_lanes: int | None = None, seed: int = 42) -> DataFrame:
    """First-fit decreasing, ties in order; longer documents are cropped to T+1 tokens, empty ones aren't placed.

    Documents of one length are alike, so the packer places the histogram of a lane's lengths
    (at most T+1 lines): runs of documents into runs of rows.  A document finds its place by
    its number among those of its length.
    """
    cap = T + 1
    rows = lane_rows(d, key, length, n_lanes, seed).filter(F.col("len") > 0)
    rows = rows.withColumn("len", F.least(F.col("len"), F.lit(cap).cast("long")))
    rows = running_sum(rows, F.lit(1).cast("long"), ORDER, by=["lane", "len"], out="at", inclusive=False)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = kernels.first_fit_runs(dict(zip(pdf["len"].tolist(), pdf["n"].tolist(), strict=True)), cap)
        out = pd.DataFrame(lines, columns=["len", "nth", "first", "each", "row0", "fill"], dtype="int64")
        return out.assign(lane=pdf["lane"].iloc[0])[["lane", *out.columns]]

    histogram = rows.groupBy("lane", "len").agg(F.count(F.lit(1)).alias("n"))
    runs = histogram.groupBy("lane").applyInPandas(place, "lane int, len long, nth long, first long, each long, row0 long, fill long")
    runs = materialised(runs, "ffd-runs")
    # the run of a document is the last one that starts at or before its number
    own = rows.select("lane", "len", "key", *SAME, "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("one"))
    starts = runs.select("lane", "len", F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("one"))
    met = running_sum(own.unionByName(starts, allowMissingColumns=True), "one", ["at", "kind"], by=["lane", "len"], out="nth").filter(F.col("kind") == 1)
    met = met.join(broadcast_if_small(runs), ["lane", "len", "nth"])
    past = F.col("at") - F.col("first")
    return met.select("lane", "key", *SAME, (F.col("row0") + F.expr("(at - first) div each")).alias("row"),
                      (F.col("fill") + past % F.col("each") * F.col("len")).alias("offset"), F.col("len").alias("take"))


# ---------------------------------------------------------------------------
# Assembly and statistics

def assemble_rows(plan: DataFrame, tokens: DataFrame, T: int, key: str = "doc_id", ids: str = "tokens",
                  pad_id: int = 0, mask: str | None = None) -> DataFrame:
    """Join tokens to their plan and build each row: ``inputs = row[:-1]``, ``targets = row[1:]``.

    ``tokens`` is the frame that was planned.

    With ``mask``, targets are -1 where ``mask[1:] == 0`` and, in padded rows,
    at positions >= content_len - 1.
    """
    cap = T + 1
    j = with_plan(tokens, plan.select("key", *SAME, *[F.col(c).alias(f"_{c}") for c in ("lane", "row", "offset", "take")]), key)
    size = F.col("_take").cast("int")
    piece = [F.col("_offset").alias("o"), F.slice(ids, 1, size).alias("ids")]
    if mask:
        piece.append(F.slice(mask, 1, size).alias("m"))
    j = j.filter(F.col("_take") > 0)
    g = j.groupBy(F.col("_lane").alias("lane"), F.col("_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct(*piece))).alias("_p"),
                                                                                F.sum("_take").alias("content_len"))
    row = F.flatten(F.transform("_p", lambda p: p["ids"]))
    padn = F.greatest(F.lit(cap) - F.size(row), F.lit(0))
    row = F.concat(row, F.array_repeat(F.lit(pad_id), padn))
    out = g.withColumn("_row", row)
    targets = F.slice("_row", 2, T)
    if mask:
        m = F.concat(F.flatten(F.transform("_p", lambda p: p["m"])), F.array_repeat(F.lit(0), padn))
        clen = F.col("content_len")
        targets = F.zip_with(targets, F.slice(m, 2, T), lambda t, mm: F.when(mm == 0, F.lit(-1)).otherwise(t))
        targets = F.when(clen < cap, F.transform(targets, lambda t, i: F.when(i >= clen - 1, F.lit(-1)).otherwise(t))) \
                   .otherwise(targets)
    return out.select("lane", "row", F.slice("_row", 1, T).alias("inputs"), targets.alias("targets"),
                      "content_len")


def packing_stats(plan: DataFrame, docs: DataFrame, T: int, key: str, length: str, name: str) -> DataFrame:
    """Utilisation, crop and pad percentages of one packing plan, and the crop floor."""
    cap = T + 1
    tot = docs.agg(F.sum(length).alias("total"),
                   F.sum(F.greatest(F.col(length) - cap, F.lit(0))).alias("over"))
    p = plan.agg(F.sum("take").alias("used"), F.countDistinct("lane", "row").alias("rows"))
    return tot.crossJoin(p).select(  # both sides are single-row aggregates
        F.lit(name).alias("packer"), "rows",
        F.round(F.col("used") / (F.col("rows") * cap) * 100.0, 4).alias("util_pct"),
        F.round((F.col("total") - F.col("used")) / F.col("total") * 100.0, 4).alias("crop_pct"),
        F.round((F.col("rows") * cap - F.col("used")) / (F.col("rows") * cap) * 100.0, 4).alias("pad_pct"),
        F.round(F.col("over") / F.col("total") * 100.0, 4).alias("floor_pct"))


def chunk_flat(d: DataFrame, T: int, key: str = "doc_id", ids: str = "tokens", length: str | None = None,
               keep_tail: bool = False) -> DataFrame:
    """Concatenate all documents in key order and cut every T+1 tokens (rows may start mid-doc).

    The global start of each document is a skew-safe prefix sum over (key, length);
    ``length`` names a column that knows it without tokenising.  Each document
    then emits one slice per row it touches, so only rows (not tokens) are grouped.
    The incomplete last row is dropped unless ``keep_tail``.
    """
    cap = T + 1
    sized = d.withColumn("_n", (F.col(length) if length else F.size(ids)).cast("long"))
    sizes = numbered_rows(sized, key, "_n")
    total = sizes.agg(F.sum("len").alias("t"))
    n_rows = total.select((F.ceil(F.col("t") / cap) if keep_tail else F.floor(F.col("t") / cap)).alias("n_rows"))
    starts = running_sum(sizes, "len", ORDER, out="start", inclusive=False).select("key", *SAME, "start")
    d = with_plan(sized, starts, key)
    r0 = (F.col("start") / cap).cast("long")
    r1 = ((F.col("start") + F.col("_n") - 1) / cap).cast("long")
    pieces = d.filter(F.col("_n") > 0).select(key, "start", ids, F.explode(F.sequence(r0, r1)).alias("row"))
    lo = F.greatest(F.col("row") * cap, F.col("start"))
    hi = F.least((F.col("row") + 1) * cap, F.col("start") + F.size(ids))
    pieces = pieces.select("row", lo.alias("pos"),
                           F.slice(ids, (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))
    rows = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_p"))
    rows = rows.join(F.broadcast(n_rows), F.col("row") < F.col("n_rows")).drop("n_rows")
    return rows.select("row", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("tokens"))


def shift_targets(rows: DataFrame, col: str = "tokens") -> DataFrame:
    n = F.size(col)
    return rows.withColumn("inputs", F.slice(col, 1, n - 1)).withColumn("targets", F.slice(col, 2, n - 1))


def rank_conversations(d: DataFrame, world: int, idx: str = "idx") -> DataFrame:
    """Rank r takes idx r, r+W, ...: ``rank = idx mod W``, ``step = idx div W``."""
    return d.withColumn("rank", (F.col(idx) % world).cast("int")).withColumn(
        "step", (F.col(idx) / world).cast("long"))
