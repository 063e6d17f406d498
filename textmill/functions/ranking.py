"""Skew-safe running sums, dense indexes and previous values.

``Window.orderBy`` without ``partitionBy`` sends every row to one task, and
``Window.partitionBy(group)`` sends a hot group to one task.  Instead the
order is cut into range buckets; each (group, bucket) runs its own window, and
a small table of per-bucket totals supplies the offsets.  Bucket edges are
tuples of *all* order columns, of any type, from a bounded sample, so repeated
first values, strings and NULLs (which come first) are spread too.  The result
doesn't depend on the number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BKT = "_bkt"
SAMPLE_PER_BUCKET = 20


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def as_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def count_not_above(edges: Column, key: Column, at_most: int) -> Column:
    """How many entries of the sorted array ``edges`` are <= ``key`` (binary search)."""
    steps = [1 << b for b in reversed(range(max(1, at_most).bit_length()))]

    def step(at: Column, s: Column) -> Column:
        return F.when((at + s <= F.size(edges)) & (F.get(edges, at + s - 1) <= key), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_bucket(df: DataFrame, order: Sequence[str | Column], n_buckets: int | None = None,
                dense: tuple[int, int] | None = None) -> DataFrame:
    """Add ``_bkt``: a bucket index that grows with ``order``.

    ``dense=(lo, hi)`` declares that the first order column holds integers spread over
    ``[lo, hi)``: buckets are exact divisions.  Otherwise edges come from the rows with the
    smallest hashes, ``SAMPLE_PER_BUCKET`` for each bucket.
    """
    n = n_buckets or default_buckets(df)
    cols = as_columns(order)
    if dense is not None:
        lo, hi = dense
        width = max(1, -(-(hi - lo) // n))
        return df.withColumn(BKT, F.coalesce(F.floor((cols[0] - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(-1)))
    keys = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    sample = keys.orderBy(F.xxhash64(*keys.columns)).limit(SAMPLE_PER_BUCKET * n)
    got = sample.orderBy(*[F.col(c).asc_nulls_first() for c in keys.columns]).collect()
    edges = [got[len(got) * k // n] for k in range(1, n)] if len(got) > 1 else []
    edges = [e for k, e in enumerate(edges) if k == 0 or e != edges[k - 1]]
    schema = T.StructType([T.StructField("_edges", T.ArrayType(keys.schema))])
    table = F.broadcast(df.sparkSession.createDataFrame([([tuple(e) for e in edges],)], schema))  # one row of n entries
    key = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(cols)])
    return df.crossJoin(table).withColumn(BKT, count_not_above(F.col("_edges"), key, n)).drop("_edges")


def running_sum(df: DataFrame, value: Column | str, order: Sequence[str | Column],
                by: Sequence[str] = (), out: str = "cum", inclusive: bool = True,
                n_buckets: int | None = None, dense: tuple[int, int] | None = None,
                previous: dict[str, str] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Prefix sum of ``value`` ordered by ``order`` (a total order, NULLs first) within ``by``.

    ``previous={"new": "col"}`` also adds the value that ``col`` has in the row before, and
    ``also={"new": value}`` further sums of the same pass.  Rows with NULL order or group keys
    are kept.
    """
    by = list(by)
    previous = previous or {}
    also = also or {}
    order = as_columns(order)
    value = F.col(value) if isinstance(value, str) else value
    values = {"_v": value, **{f"_v_{new}": v for new, v in also.items()}}
    base = with_bucket(df.withColumns(values), order, n_buckets, dense)
    w = Window.partitionBy(*by, BKT).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = base.withColumns({f"_local{v}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for v in values})
    if previous:
        local = local.withColumn("_nth", F.row_number().over(w))
    for new, col in previous.items():
        local = local.withColumn(new, F.lag(col).over(w))
    last = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    totals = base.groupBy(*by, BKT).agg(*[F.sum(v).alias(f"_tot{v}") for v in values], *[F.max_by(c, last).alias(f"_last_{n}") for n, c in previous.items()])
    wo = Window.partitionBy(*by).orderBy(BKT)
    offsets = totals.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(BKT).alias("_b2"),
                            *[F.coalesce(F.sum(f"_tot{v}").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_off{v}") for v in values],
                            *[F.lag(f"_last_{n}").over(wo).alias(f"_last_{n}") for n in previous])
    if not by:
        offsets = F.broadcast(offsets)  # one row per bucket
    on = F.col(BKT) == F.col("_b2")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    res = local.join(offsets, on).withColumns({new: F.col(f"_local{v}") + F.col(f"_off{v}") for new, v in zip([out, *also], values, strict=True)})
    for new in previous:
        res = res.withColumn(new, F.when(F.col("_nth") == 1, F.col(f"_last_{new}")).otherwise(F.col(new)))
    return res.drop(*values, *[f"_local{v}" for v in values], *[f"_off{v}" for v in values], BKT, "_b2", "_nth", *[f"_by{i}" for i in range(len(by))], *[f"_last_{n}" for n in previous])


def dense_index(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
                out: str = "idx", n_buckets: int | None = None,
                dense: tuple[int, int] | None = None, previous: dict[str, str] | None = None) -> DataFrame:
    """0-based position of each row in ``order`` within ``by`` (skew-safe row_number - 1)."""
    return running_sum(df, F.lit(1).cast("long"), order, by, out, inclusive=False,
                       n_buckets=n_buckets, dense=dense, previous=previous)


def last_known(df: DataFrame, value: str, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "known",
               n_buckets: int | None = None) -> DataFrame:
    """The last non-NULL ``value`` up to each row, itself included, in ``order`` within ``by`` (an as-of carry).

    As with ``running_sum``, windows end at bucket edges, and a small table says what each
    bucket starts with.
    """
    by = list(by)
    order = as_columns(order)
    base = with_bucket(df, order, n_buckets)
    w = Window.partitionBy(*by, BKT).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumn("_local", F.last(value, ignorenulls=True).over(w))
    given = base.filter(F.col(value).isNotNull())
    ends = given.groupBy(*by, BKT).agg(F.max_by(value, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])).alias("_end"))
    buckets = base.select(*by, BKT).distinct().join(ends.withColumnsRenamed({**{b: f"_e{i}" for i, b in enumerate(by)}, BKT: "_eb"}),
                                                    _same(by, "_e", "_eb"), "left")
    before = Window.partitionBy(*by).orderBy(BKT).rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(BKT).alias("_b2"), F.last("_end", ignorenulls=True).over(before).alias("_start"))
    got = local.join(starts, _same(by, "_by", "_b2"))
    return got.withColumn(out, F.coalesce("_local", "_start")).drop("_local", "_start", BKT, "_b2", *[f"_by{i}" for i in range(len(by))])


def _same(by: Sequence[str], prefix: str, bucket: str) -> Column:
    on = F.col(BKT) == F.col(bucket)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"{prefix}{i}"))
    return on
