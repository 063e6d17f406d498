"""Queries: shard scans and writers, chat JSONL, score CSV and log extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat
from ..operators import tokenize as tok
from ..session import scratch_path
from ..sources import shards as S
from .fixtures import table
from .registry import query

RG = 8  # rows per row group in the tests (1024 for real shards)


def positioned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.substring("source", 4, 9).cast("int").alias("shard_id"))
    return S.with_shard_position(d)


def written(spark, sf_dir):
    """A folder of shards with row groups of ``RG`` rows."""
    path = scratch_path(spark, "shards")
    S.write_text_shards(positioned(spark, sf_dir), path, row_group=RG)
    return path


POS_SQL = """pos AS (SELECT doc_id, text, CAST(substr(source, 4) AS INTEGER) AS shard_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_in_shard FROM documents),
rg AS (SELECT *, row_in_shard // 8 AS row_group, max(shard_id) OVER () AS last_shard FROM pos)"""


@query("scan_text_shards", oracle=f"""WITH {POS_SQL}
SELECT doc_id, shard_id, row_in_shard, row_group FROM rg WHERE shard_id < last_shard AND row_group % 3 = 1""")
def q_scan_text_shards(spark, sf_dir):
    r = S.scan_text_shards(spark, written(spark, sf_dir), "train", rank=1, world=3, size=RG)
    return r.select("doc_id", "shard_id", "row_in_shard", "row_group")


@query("split_last_shard", oracle=f"""WITH {POS_SQL}
SELECT doc_id, CASE WHEN shard_id < last_shard THEN 'train' ELSE 'val' END AS split FROM rg""")
def q_split_last_shard(spark, sf_dir):
    path = written(spark, sf_dir)
    of = lambda split: S.scan_text_shards(spark, path, split, size=RG).select("doc_id", F.lit(split).alias("split"))
    return of("train").unionByName(of("val"))


@query("row_group_of", oracle=f"""WITH {POS_SQL}
SELECT doc_id, row_group, (row_in_shard % 8) // 2 AS sub_batch FROM rg""")
def q_row_group_of(spark, sf_dir):
    return S.row_group_of(positioned(spark, sf_dir), RG, sub=2).select("doc_id", "row_group", "sub_batch")


@query("rank_shard", oracle=f"WITH {POS_SQL} SELECT doc_id, shard_id, row_group FROM rg WHERE row_group % 4 = 2")
def q_rank_shard(spark, sf_dir):
    return S.rank_shard(S.row_group_of(positioned(spark, sf_dir), RG), 2, 4).select("doc_id", "shard_id", "row_group")


@query("resume_after", oracle=f"""WITH {POS_SQL}
SELECT doc_id, shard_id, row_group FROM rg
WHERE (shard_id > 5 OR (shard_id = 5 AND row_group >= (2 // 2 + 1) * 2 + 1)) AND row_group % 2 = 1""")
def q_resume_after(spark, sf_dir):
    r = S.scan_text_shards(spark, written(spark, sf_dir), None, rank=1, world=2, size=RG, after=(5, 2))
    return r.select("doc_id", "shard_id", "row_group")


@query("resume_epochs", oracle=f"""WITH {POS_SQL}
SELECT 3 AS epoch, doc_id FROM rg WHERE (shard_id > 5 OR (shard_id = 5 AND row_group >= (2 // 2 + 1) * 2 + 1)) AND row_group % 2 = 1
UNION ALL SELECT 4, doc_id FROM rg WHERE row_group % 2 = 1""")
def q_resume_epochs(spark, sf_dir):
    """The rest of epoch 3 after a position, then epoch 4 from its start."""
    d = S.row_group_of(positioned(spark, sf_dir), RG)
    return S.epochs_after(d, epoch=3, pq=5, rg=2, rank=1, world=2, last_epoch=4).select("epoch", "doc_id")


@query("skip_done", oracle=f"WITH {POS_SQL} SELECT doc_id, shard_id FROM pos WHERE shard_id % 2 = 1")
def q_skip_done(spark, sf_dir):
    d = positioned(spark, sf_dir)
    done = d.select("shard_id").distinct().filter(F.col("shard_id") % 2 == 0)
    return S.skip_done(d, done, ["shard_id"]).select("doc_id", "shard_id")


@query("shard_summary", oracle="""
SELECT CAST(substr(source, 4) AS INTEGER) AS shard_id, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens
FROM documents GROUP BY 1""")
def q_shard_summary(spark, sf_dir):
    d = positioned(spark, sf_dir).withColumn("tokens", tok.ByteEncoder().encode(F.col("text")))
    d = d.withColumn("tokens", F.concat(F.array(F.lit(tok.ByteEncoder().bos)), "tokens"))
    return S.shard_summary(d, tokens="tokens")


SUMMARY_SQL = """
SELECT CAST(substr(source, 4) AS INTEGER) AS shard_id, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars
FROM documents GROUP BY 1"""


@query("write_text_shards", oracle=SUMMARY_SQL)
def q_write_text_shards(spark, sf_dir):
    path = scratch_path(spark, "text-shards")
    d = positioned(spark, sf_dir)
    S.write_text_shards(d.filter(F.col("shard_id") < 10), path)
    S.write_text_shards(d, path)  # second pass only adds the shards that are missing
    return S.shard_summary(spark.read.parquet(path))


@query("write_repack_shards", oracle=SUMMARY_SQL)
def q_write_repack_shards(spark, sf_dir):
    path = scratch_path(spark, "repack-shards")
    S.write_text_shards(positioned(spark, sf_dir), path, repack=True)
    return S.shard_summary(spark.read.parquet(path))


@query("write_token_shards", oracle="""
SELECT CAST(substr(source, 4) AS INTEGER) AS shard_id, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens
FROM documents GROUP BY 1""")
def q_write_token_shards(spark, sf_dir):
    path = scratch_path(spark, "token-shards")
    enc = tok.ByteEncoder()
    tokens = F.concat(F.array(F.lit(enc.bos)), enc.encode(F.col("text"))).alias("tokens")
    S.write_text_shards(positioned(spark, sf_dir), path, columns=[tokens])
    return S.shard_summary(spark.read.parquet(path), tokens="tokens")


@query("scan_tokens_or_text", oracle="""
SELECT 'text' AS source_kind, count(*) AS n_rows, sum(length(text))::BIGINT AS size FROM documents
UNION ALL SELECT 'tokens', count(*), sum(strlen(text))::BIGINT FROM documents""")
def q_scan_tokens_or_text(spark, sf_dir):
    """An empty token folder falls back to the text shards; a filled one is used."""
    text_dir, token_dir = scratch_path(spark, "text-for-scan"), scratch_path(spark, "tokens-for-scan")
    d = positioned(spark, sf_dir)
    S.write_text_shards(d, text_dir)
    text = S.scan_tokens_or_text(spark, token_dir, text_dir)
    S.write_text_shards(d, token_dir, columns=[tok.ByteEncoder().encode(F.col("text")).alias("tokens")])
    tokens = S.scan_tokens_or_text(spark, token_dir, text_dir)
    n = F.count(F.lit(1)).alias("n_rows")
    return text.groupBy("source_kind").agg(n, F.sum(F.length("text")).cast("long").alias("size")).unionByName(
        tokens.groupBy("source_kind").agg(n, F.sum(F.size("tokens")).cast("long").alias("size")))


@query("shard_inventory", oracle="""
SELECT count(DISTINCT source) AS n_files, true AS has_bytes, count(*) AS n_rows FROM documents""")
def q_shard_inventory(spark, sf_dir):
    """Files of the shards written from the documents (small ones, so one file each), and their rows."""
    path = scratch_path(spark, "inventory")
    S.write_text_shards(positioned(spark, sf_dir), path)
    inv = S.shard_inventory(spark, path)
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    return inv.crossJoin(rows).select("n_files", (F.col("bytes") > 0).alias("has_bytes"), "n_rows")  # single rows


def conv_messages(spark, sf_dir):
    return chat.messages_from_turns(table(spark, sf_dir, "conversations"))


# Blank lines are skipped; the others are no arrays of messages with string content.
JUNK_LINES = ["", "   ", "\t", "{not json", '{"role": "user", "content": "x"}', '[{"role": "user", "content": 5}]', '[{"role": "user"}]', "7"]


@query("read_chat_jsonl", oracle="""
SELECT n AS n_messages, count(*) AS n_conversations FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
GROUP BY n UNION ALL SELECT -1, 5""")
def q_read_chat_jsonl(spark, sf_dir):
    path = scratch_path(spark, "chat-jsonl")
    S.write_chat_jsonl(conv_messages(spark, sf_dir), path)
    junk = spark.createDataFrame([(x,) for x in JUNK_LINES], "value string")
    junk.write.mode("append").text(path)
    good, rejects = S.read_chat_jsonl(spark, path)
    return good.groupBy(F.size("messages").cast("long").alias("n_messages")).agg(F.count(F.lit(1)).alias("n_conversations")).unionByName(
        rejects.agg(F.lit(-1).cast("long").alias("n_messages"), F.count(F.lit(1)).alias("n_conversations")))


@query("write_chat_jsonl", oracle="""
SELECT conv_id % 2 AS half, count(DISTINCT conv_id) AS n_lines, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars
FROM conversations GROUP BY 1""")
def q_write_chat_jsonl(spark, sf_dir):
    """Written in two appends with metadata, and read back."""
    path = scratch_path(spark, "chat-out")
    c = conv_messages(spark, sf_dir).withColumn("metadata", F.struct((F.col("conv_id") % 2).alias("half")))
    S.write_chat_jsonl(c.filter("conv_id % 2 = 0"), path, metadata="metadata")
    S.write_chat_jsonl(c.filter("conv_id % 2 = 1"), path, append=True, metadata="metadata")
    line = F.from_json("value", "struct<messages:array<struct<role:string,content:string>>,metadata:struct<half:bigint>>")
    back = spark.read.text(path).select(line.alias("l")).select("l.metadata.half", "l.messages")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"]))
    return back.groupBy("half").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.size("messages")).cast("long").alias("n_messages"),
                                    F.sum(chars).cast("long").alias("n_chars"))


SCORE_SQL = """SELECT 'item' || item_id AS task, item_id / 100.0 AS acc,
       CASE WHEN item_id % 7 = 0 THEN NULL ELSE (item_id - 10) / 50.0 END AS centered
FROM benchmark WHERE item_id % 11 <> 0"""


@query("read_score_csv", oracle=SCORE_SQL)
def q_read_score_csv(spark, sf_dir):
    """A score CSV written from the benchmark items: header, blanks, unparsable rows."""
    b = table(spark, sf_dir, "benchmark")
    iid = F.col("item_id")
    line = F.concat_ws(", ", F.concat(F.lit("item"), iid.cast("string")), (iid / 100.0).cast("string"),
                       F.when(iid % 7 == 0, F.lit("")).otherwise(((iid - 10) / 50.0).cast("string")))
    line = F.when(iid % 11 == 0, F.concat(F.lit("item"), iid.cast("string"), F.lit(", n/a, x"))).otherwise(line)
    header = spark.createDataFrame([("Task, accuracy, centered",), ("",)], "value string")
    path = scratch_path(spark, "scores-csv")
    header.unionByName(b.select(line.alias("value"))).write.text(path)
    return S.read_score_csv(spark, path)


def run_log_lines(spark, sf_dir):
    """Training log lines per run (user), derived from the events."""
    e = table(spark, sf_dir, "events")
    from ..operators.runs import with_steps
    steps = with_steps(e.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id",
                       ["ts_us", "event_id"]).withColumn("step", F.col("step") + 1)
    body = steps.select(F.col("user_id").alias("run"), (F.col("step") * 2).alias("line_no"),
                        F.format_string("step %05d | loss: %.4f", "step", "value").alias("value"))
    val = steps.filter(F.col("step") % 10 == 0).select(
        F.col("user_id").alias("run"), (F.col("step") * 2 + 1).alias("line_no"),
        F.format_string("Validation bpb: %.4f", F.col("value") / 10).alias("value"))
    head = e.select("user_id").distinct().select(F.col("user_id").alias("run"), F.lit(0).cast("long").alias("line_no"),
                                                 F.concat(F.lit("Calculated number of iterations: "),
                                                          F.format_number(F.col("user_id") * 997 + 1000, 0)).alias("value"))
    return body.unionByName(val).unionByName(head)


PATTERNS = {"val_bpb": r"Validation bpb: ([0-9.]+)", "num_iterations": r"Calculated number of iterations: ([0-9,]+)"}


DERIVED = {"tokens_trained": "num_iterations * 524288", "model_dim": "run % 32 * 64"}


@query("extract_run_metrics", oracle="""WITH s AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id AS run, round(arg_max(value, step) FILTER (WHERE step % 10 = 0) / 10, 4) AS val_bpb,
       (user_id * 997 + 1000)::DOUBLE AS num_iterations, (user_id * 997 + 1000) * 524288.0::DOUBLE AS tokens_trained, user_id % 32 * 64 AS model_dim
FROM s GROUP BY user_id""")
def q_extract_run_metrics(spark, sf_dir):
    """The depth of a run stands in its name; its model dimension and tokens are derived."""
    return S.extract_run_metrics(run_log_lines(spark, sf_dir), PATTERNS, derived=DERIVED).select(
        "run", F.round("val_bpb", 4).alias("val_bpb"), "num_iterations", "tokens_trained", "model_dim")


RUN_FILE_SQL = """SELECT (l_linenumber * 100)::VARCHAR AS flops_budget, l_suppkey AS depth, min(l_quantity::BIGINT) AS num_iterations,
       min(CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_discount END) AS val_bpb
FROM lineitem GROUP BY l_linenumber, l_suppkey"""


def run_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    zero = [F.lit(0).cast("long").alias(c) for c in S.RUN_CSV.split(",")
            if c not in ("flops_budget", "depth", "num_iterations", "val_bpb", "train_time_sec")]
    g = li.groupBy((F.col("l_linenumber") * 100).cast("string").alias("flops_budget"), F.col("l_suppkey").alias("depth")).agg(
        F.min(F.col("l_quantity").cast("long")).alias("num_iterations"), F.min("l_discount").alias("b"))
    return g.select("*", *zero, F.when(F.col("depth") % 7 != 0, F.col("b")).alias("val_bpb"), F.lit(1.5).alias("train_time_sec"))


@query("append_run_csv", oracle=RUN_FILE_SQL)
def q_append_run_csv(spark, sf_dir):
    """Appended in two steps, the second of which repeats the first: every run is there once."""
    path = scratch_path(spark, "runs-csv")
    r = run_rows(spark, sf_dir)
    S.append_run_csv(r.filter("depth % 2 = 0"), path)
    S.append_run_csv(r, path)
    return S.read_run_csv(spark, path).select("flops_budget", "depth", "num_iterations", "val_bpb")


@query("read_run_csv", oracle=f"SELECT count(*) AS n_runs, count(val_bpb) AS n_scored, sum(num_iterations)::BIGINT AS iterations FROM ({RUN_FILE_SQL})")
def q_read_run_csv(spark, sf_dir):
    path = scratch_path(spark, "runs-csv-read")
    S.append_run_csv(run_rows(spark, sf_dir), path)
    return S.read_run_csv(spark, path).agg(F.count(F.lit(1)).alias("n_runs"), F.count("val_bpb").alias("n_scored"),
                                           F.sum("num_iterations").cast("long").alias("iterations"))


@query("extract_section_kv", oracle="""
SELECT event_type AS section, 'count' AS key, count(*) FILTER (WHERE value > 50)::VARCHAR AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 'mean', printf('%.4f', avg(value)) FROM events GROUP BY 1""")
def q_extract_section_kv(spark, sf_dir):
    """Report sections per event type; the later 'count' line overrides the earlier one."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("event_type").alias("section")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("n_big"), F.avg("value").alias("m"))
    lines = (g.select("section", F.lit(1).alias("line_no"), F.concat(F.lit("- count: "), F.col("n").cast("string")).alias("value"))
             .unionByName(g.select("section", F.lit(2).alias("line_no"),
                                   F.concat(F.lit("- mean value: "), F.format_string("%.4f", "m")).alias("value")))
             .unionByName(g.select("section", F.lit(3).alias("line_no"),
                                   F.concat(F.lit("- big count: "), F.col("n_big").cast("string")).alias("value")))
             .unionByName(g.select("section", F.lit(0).alias("line_no"), F.lit("timestamp: 2024-01-01 00:00:00").alias("value"))))
    return S.extract_section_kv(lines, ["count", "mean"]).select("section", "key", "value")
