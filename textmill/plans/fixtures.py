"""How the driver's test tables stand in for the operators' inputs.

Sources are the document languages; shards are the ``source`` names
(``src7`` -> shard 7) ordered by ``doc_id``; the quality label times two is
the education score.  Each fixture has a matching SQL fragment for the
DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Source spec: (source, weight, min_len, use_score, spec_idx).  Integer weights
# keep the cumulative-weight comparison exact in both engines.
SPEC_ROWS = [
    ("en", 40, 200, True, 0),
    ("de", 25, 100, False, 1),
    ("fr", 20, 0, False, 2),
    ("es", 15, 50, True, 3),
]
SPEC_SCHEMA = "source string, weight int, min_len int, use_score boolean, spec_idx int"
SPEC_SQL = "spec(source, weight, min_len, use_score, spec_idx) AS (VALUES " + ", ".join(
    f"('{s}', {w}, {m}, {str(u).lower()}, {i})" for s, w, m, u, i in SPEC_ROWS) + ")"


def spec_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEC_ROWS, SPEC_SCHEMA)


def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as multi-source input: (doc_id, shard, source, text, n_chars)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("shard"), F.col("lang").alias("source"), "text",
        F.length("text").cast("long").alias("n_chars"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2.0).alias("score"))


SOURCE_DOCS_SQL = ("source_docs AS (SELECT doc_id, source AS shard, lang AS source, text, "
                   "length(text) AS n_chars FROM documents)")

FILTERED_SQL = f"""
{SPEC_SQL},
{SOURCE_DOCS_SQL},
filtered AS (
  SELECT d.* FROM source_docs d JOIN spec s ON d.source = s.source
  LEFT JOIN (SELECT doc_id, quality * 2.0 AS score FROM labels) l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND length(d.text) > 0 AND length(d.text) >= s.min_len
    AND (NOT s.use_score OR coalesce(l.score, 0.0) >= 2.0))"""
