"""Size-checked broadcast and one-row lookup arrays.

Only sides with a checked row count are broadcast: above the bound the plain
DataFrame is returned, Spark plans a shuffle join (AQE may still switch to
broadcast at run time), and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def dense_array(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """One row: the array whose entry ``key`` is ``value``; null where an id is missing.

    For vocabulary-sized tables, so that a per-token lookup is an array access
    rather than a join on a hot key.
    """
    top = df.agg(F.max(key)).first()[0]
    ids = df.sparkSession.range(0 if top is None else int(top) + 1).select(F.col("id").alias("_id"))
    full = ids.join(df.select(F.col(key).cast("long").alias("_id"), F.col(value).alias("_v")), "_id", "left")
    entries = F.array_sort(F.collect_list(F.struct("_id", "_v")))
    return full.agg(F.transform(entries, lambda e: e["_v"]).alias(out))
