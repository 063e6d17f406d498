"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is one space; a null
text counts as empty.  Three combining stages, each grouping by digest *and* full content:

1. local: the map side of the first aggregation leaves one row per text and partition;
2. salted: these meet in ``salts`` groups per text, by the partition they come from;
3. global: the few salt winners of a text meet.

A group of copies that holds a third of all rows thus reaches the last stage as ``salts``
rows.  Rows then find their winner by the 32-byte digest; digests that have several contents
(none is known for SHA-256) are resolved by content.

Defined cases: null or empty text is the empty string; null ids lose against any id; rows that
repeat both id and text form one group, of which one row is kept; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_rows, cut, table

SALTS = 16


def normalised(text: Column) -> Column:
    """Whitespace runs as one space; runs that are one space already aren't matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    base = docs.select(F.col(id_col).alias("i"), normalised(F.col(text_col)).alias("t"), *keep)
    return base.withColumn("d", F.unhex(F.sha2("t", 256)))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """(d, keep_id, group_size, t): the row that stays, one per distinct text.

    ``t`` is null unless the digest has several contents.
    """
    keyed = _keyed(docs, id_col, text_col).withColumn("s", F.spark_partition_id() % salts)
    salted = keyed.groupBy("d", "t", "s").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("d").groupBy("d", "t").agg(F.min("i").alias("i"), F.sum("n").alias("n"))
    # grouping by digest needs no further exchange; the content goes on only where digests collide
    per = whole.groupBy("d").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("keep_id"), F.sum("n").alias("group_size"))
    found = cut(per, "exact-winners")
    sole = found.filter("c = 1").select("d", "keep_id", "group_size", F.lit(None).cast("string").alias("t"))
    clash = found.filter("c > 1").select("d")
    if clash.isEmpty():
        return sole
    again = _keyed(docs, id_col, text_col).join(clash, "d", "left_semi")
    return sole.unionByName(again.groupBy("d", "t").agg(F.min("i").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                            .select("d", "keep_id", "group_size", "t"))


def _same(content: Column) -> Column:
    return F.col("w.t").isNull() | (F.col("w.t") == content)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    best = winners(docs, id_col, text_col, salts)
    # rows that repeat id and text are counted, not listed; digests stand for texts (see winners)
    rows = _keyed(docs, id_col, text_col).groupBy("i", "d").agg(F.count(F.lit(1)).alias("m"))
    if not best.filter("t is not null").isEmpty():
        rows = _keyed(docs, id_col, text_col).groupBy("i", "d", "t").agg(F.count(F.lit(1)).alias("m"))
        joined = rows.alias("r").join(best.alias("w"), (F.col("r.d") == F.col("w.d")) & _same(F.col("r.t")))
    else:
        joined = rows.alias("r").join(best.alias("w"), F.col("r.d") == F.col("w.d"))
    one = joined.select(F.col("r.i").alias("doc_id"), "w.keep_id", "w.group_size", F.lower(F.hex("r.d")).alias("text_sha256"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.m"))).alias("nth"))
    return one.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of equal texts the one with the smallest id."""
    best = winners(docs, id_col, text_col, salts).select(F.col("keep_id"), F.col("d").alias("w"), F.col("t").alias("c"))
    text = normalised(F.col("row")[text_col])
    mine = as_rows(docs).select("row", F.col("row")[id_col].alias("i"), F.unhex(F.sha2(text, 256)).alias("d"))
    hit = mine.join(best, F.col("i").eqNullSafe(F.col("keep_id")) & (F.col("d") == F.col("w")) & (F.col("c").isNull() | (F.col("c") == text)))
    # a digest may have several contents, each with its own winner
    nth = F.row_number().over(Window.partitionBy("i", "d", "c").orderBy(F.lit(1)))
    return hit.withColumn("n", nth).filter("n = 1").select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size,
       n.doc_id = g.keep_id AND row_number() OVER (PARTITION BY n.doc_id, n.t) = 1 AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
