"""Queries: streaming jobs replayed over files written from the test tables.

Each query writes its input in several files, runs the stream to completion
(``availableNow``) and returns the sink read back as a batch DataFrame, so
"stream result = batch result" is checked by the same oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokenize as tok
from ..operators.pack import lane_of
from ..session import materialised, scratch_path
from ..sources import shards as S
from ..streaming import jobs
from ..streaming.packing import packed_rows, stream_pack
from . import runs  # noqa: F401  the batch EMA's oracle
from .chats import REQUEST_SQL, convs, request_params
from .fixtures import SEED, source_docs, table
from .io import positioned
from .packing import BESTFIT_CROP_SQL, SUMS_SQL, T, lane_sql, lanes
from .registry import ORACLES, query


ROWS_PER_FILE = 50_000
WIDE_ROWS = 10_000  # of a file of texts or tokens
ARRIVALS = 4  # micro-batches that a replayed table comes in, whatever its size


def files_for(n_rows: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Files of one of the ``ARRIVALS``, which one micro-batch reads."""
    return max(1, -(-n_rows // (ARRIVALS * rows_per_file)))


def replayed(d, at, src: str, rows_per_file: int = ROWS_PER_FILE, derive=lambda part: part) -> int:
    """Write ``d`` to ``src`` in ``ARRIVALS`` parts, in the order of ``at``; returns the files of a part.

    The file source goes by modification time, so the parts, written one after the other, arrive
    in this order, if a micro-batch takes as many files as each of them has.  ``derive`` makes the
    columns of a part after its rows are dealt to its files.
    """
    d = d.withColumn("_at", at)
    n = d.count()
    files = files_for(n, rows_per_file)
    ordered = materialised(d.repartitionByRange(ARRIVALS * files, "_at"), "stream-slices")  # a slice reads its own files only
    edges = [int(x) for x in ordered.approxQuantile("_at", [k / ARRIVALS for k in range(1, ARRIVALS)], 0.1 / ARRIVALS)]
    after = [None, *sorted(set(edges))]
    parts = []
    for lo, hi in zip(after, [*after[1:], None], strict=True):
        part = ordered
        if lo is not None:
            part = part.filter(F.col("_at") >= lo)
        if hi is not None:
            part = part.filter(F.col("_at") < hi)
        parts.append(part)
    if files > 1:  # rows are dealt in turn, so each file gets some if a task has as many rows as there are files
        rows = [part.count() for part in parts]
        files = max(1, min([files, *[r // max(1, part.rdd.getNumPartitions()) for r, part in zip(rows, parts, strict=True)]]))
    for part in parts:
        part = part.drop("_at")
        derive(part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(src)
    return files


@query("stream_tokenize_new_shards", oracle="""
SELECT CAST(substr(source, 4) AS INTEGER) AS shard_id, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens
FROM documents GROUP BY 1""")
def q_stream_tokenize_new_shards(spark, sf_dir):
    src, out, ck = (scratch_path(spark, n) for n in ("stream-text", "stream-tokens", "stream-ck"))
    S.write_text_shards(positioned(spark, sf_dir), src)
    jobs.stream_tokenize_new_shards(spark, src, out, ck, files_per_trigger=4)
    return S.shard_summary(spark.read.parquet(out), tokens="tokens")


@query("stream_validate_requests", oracle=f"""WITH {REQUEST_SQL},
r AS (SELECT k.reason, c.n FROM checked k JOIN c ON k.conv_id = c.conv_id UNION ALL SELECT 'unreadable', 0 UNION ALL SELECT 'unreadable', 0)
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n_requests, sum(n)::BIGINT AS n_messages FROM r GROUP BY 1""")
def q_stream_validate_requests(spark, sf_dir):
    """Requests as JSON objects with their sampling parameters, and two lines that are none."""
    src, out, ck = (scratch_path(spark, n) for n in ("stream-req", "stream-req-out", "stream-req-ck"))
    msgs = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    c = request_params(convs(spark, sf_dir)).select(F.to_json(F.struct(
        msgs.alias("messages"), "temperature", F.col("top_k").cast("int").alias("top_k"), F.col("max_tokens").cast("int").alias("max_tokens"))).alias("value"))
    c.unionByName(spark.createDataFrame([("{broken",), ("[1,",)], "value string")).repartition(4).write.text(src)
    jobs.stream_validate_requests(spark, src, out, ck)
    r = spark.read.parquet(out)
    return r.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("n_messages").cast("long").alias("n_messages"))


@query("stream_mix_counts", oracle="""
SELECT lang AS source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1""")
def q_stream_mix_counts(spark, sf_dir):
    src, out, ck = (scratch_path(spark, n) for n in ("stream-docs", "stream-mix", "stream-mix-ck"))
    d = source_docs(spark, sf_dir)
    files = files_for(d.count(), WIDE_ROWS)
    d.repartition(ARRIVALS * files).write.parquet(src)
    jobs.stream_mix_counts(spark, src, out, ck, files_per_trigger=files)
    return jobs.latest_totals(spark, out)


@query("stream_ema", oracle=ORACLES["ema_debiased"])
def q_stream_ema(spark, sf_dir):
    """The events arrive in files, in time order; the result is that of the batch EMA."""
    src, out, ck = (scratch_path(spark, n) for n in ("stream-events", "stream-ema", "stream-ema-ck"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    files = replayed(e, F.col("ts_us"), src)
    jobs.stream_ema(spark, src, out, ck, files_per_trigger=files)
    return jobs.streamed_ema(spark, out).select(F.col("run").alias("user_id"), "step", F.round("ema", 6).alias("ema"))


@query("stream_pack", oracle=f"""WITH RECURSIVE {lane_sql('strlen(text) + 1')}, {BESTFIT_CROP_SQL},
sums AS ({SUMS_SQL.replace(chr(10) + "SELECT lane", " SELECT lane").replace("k AS (", "WITH k AS (", 1)})
SELECT lane, row, inputs_sum, targets_sum FROM sums""")
def q_stream_pack(spark, sf_dir):
    """Documents arrive in files, in the order of their ids, which stand for seconds; a heartbeat flushes all lanes.

    The rows are those that ``pack_bestfit_crop`` makes of all documents at once.
    """
    src, out, ck = (scratch_path(spark, n) for n in ("stream-tokens-in", "stream-packed", "stream-pack-ck"))
    enc = tok.ByteEncoder()
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (enc.count(F.col("text")) + 1).cast("long").alias("n_tokens"))
    n = lanes(d, "n_tokens")
    key = F.format_string("%020d", "doc_id").alias("key")
    d = d.select(lane_of("doc_id", n, SEED).alias("lane"), key, F.timestamp_seconds(F.col("doc_id") + 1).alias("time"), "text")
    tokens = F.concat(F.array(F.lit(enc.bos)), enc.encode(F.col("text"))).alias("tokens")
    files = replayed(d, F.unix_seconds("time"), src, WIDE_ROWS, lambda part: part.select("lane", "key", "time", tokens))
    last = d.agg(F.max("time").alias("t")).select(F.lit(None).cast("int").alias("lane"), F.lit("").alias("key"), (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("time"),
                                                  F.lit(None).cast("array<int>").alias("tokens"))
    last.coalesce(1).write.mode("append").parquet(src)
    stream_pack(spark, src, out, ck, T, late_s=0, files_per_trigger=files)
    s = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return packed_rows(spark, out).select("lane", "row", s("inputs").alias("inputs_sum"), s("targets").alias("targets_sum"))
