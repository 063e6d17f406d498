"""Helpers shared by the corpus operators: table access, lineage cuts, packed binary columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import ensure_checkpoint_dir

# Whitespace of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder (any Hadoop file system)."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, cuts lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row``, so that names of other columns can't clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_index(df: DataFrame, *order: Column, name: str = "order") -> DataFrame:
    """Add ``rank``: a long that grows with ``order`` (not dense), by a range-partitioned sort.

    The result is written, so that the sampled range bounds are fixed for every later reader.
    """
    done = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    return cut(done.withColumn("rank", F.monotonically_increasing_id()), name)


def dense_sorted_index(df: DataFrame, *order: Column, name: str = "order") -> DataFrame:
    """``sorted_index`` made dense (0, 1, ...): part sizes are summed, one row per partition."""
    ranked = sorted_index(df, *order, name=name)
    part = F.shiftright("rank", 33)
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()
    starts, total = [], 0  # as many entries as partitions
    for r in sorted(sizes):
        starts.append((r[0], total))
        total += r[1]
    spark = df.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "__part long, __at long"))
    within = F.col("rank").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranked.withColumn("__part", part.cast("long")).join(offsets, "__part")
            .withColumn("rank", within + F.col("__at")).drop("__part", "__at"))
