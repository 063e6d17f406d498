"""Rows told apart where their keys repeat or are NULL.

A plan is made of narrow rows and joined back to the wide ones.  By the key alone, a key that
two rows share would multiply them, and a NULL key would lose them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME = ["_h1", "_h2"]  # hashes of all columns, 0 where keys tell all rows apart
NTH = "_nth"  # counts the rows that agree in all columns


def _hashes(d: DataFrame, keys: Sequence[str]) -> tuple[dict[str, Column], bool]:
    """Values of ``SAME``, and whether they are needed: keys that tell all rows apart save reading the other columns."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if counts.filter((F.col("_rows") > 1) | missing).isEmpty():
        return {c: F.lit(0).cast("long") for c in SAME}, False
    return {"_h1": F.xxhash64(*d.columns), "_h2": F.hash(*d.columns).cast("long")}, True


def numbered(d: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Keys, ``SAME``, ``_nth`` and values of each row: keys, ``SAME`` and ``_nth`` together are unique."""
    rows = d.select(*keys, *[c.alias(n) for n, c in {**_hashes(d, keys)[0], **values}.items()])
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_rows"))
    return copies.withColumn(NTH, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_rows")


def with_lines(d: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``d`` with its lines (keys, ``SAME`` and more) of a plan, null-safe.

    Rows that agree in every column are one row here, which all their lines share.
    """
    same, repeated = _hashes(d, keys)
    rows = d.withColumns(same)
    if repeated:
        rows = rows.dropDuplicates([*keys, *SAME])
    names = {c: f"_line_{c}" for c in [*keys, *SAME]}
    lines = lines.drop(NTH).withColumnsRenamed(names)
    on = F.lit(True)
    for c in [*keys, *SAME]:
        on = on & (F.col(c).eqNullSafe(F.col(names[c])) if c in keys else F.col(c) == F.col(names[c]))
    return rows.join(lines, on).drop(*SAME, *names.values())
