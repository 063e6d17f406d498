"""Structured Streaming jobs.

File sources with ``maxFilesPerTrigger`` replay the input; the checkpoint
location replaces the reference's skip-if-exists and resume bookkeeping, and
``trigger(availableNow=True)`` processes what is there and stops.  Sinks are
parquet folders (commit protocol, exactly once); nothing is collected on the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sizing import broadcast_if_small
from ..operators import chat, runs
from ..operators import tokenize as tok
from ..session import materialised


def _run(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_tokenize_new_shards(spark: SparkSession, src: str, out: str, checkpoint: str,
                               files_per_trigger: int = 1) -> StreamingQuery:
    """Tokenise text shards as they appear; each shard file is processed exactly once."""
    schema = spark.read.parquet(src).schema
    enc = tok.ByteEncoder()
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
         .select("shard_id", "row_in_shard", F.concat(F.array(F.lit(enc.bos)), enc.encode(F.col("text"))).alias("tokens")))
    q = (s.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .partitionBy("shard_id").trigger(availableNow=True).start(out))
    _run(q)
    return q


REQUEST = "struct<messages:array<struct<role:string,content:string>>,temperature:double,top_k:int,max_tokens:int>"


def stream_validate_requests(spark: SparkSession, src: str, out: str, checkpoint: str,
                             files_per_trigger: int = 1) -> StreamingQuery:
    """Stateless validation of incoming chat requests: a JSON object, or an array of messages, per line.

    What can't be read as either is returned with the reason ``unreadable``.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(src)
    text = F.trim("value")
    request = F.from_json(text, REQUEST)
    listed = F.from_json(text, "array<struct<role:string,content:string>>")
    d = lines.select(request.alias("_r"), F.coalesce(request["messages"], F.when(text.startswith("["), listed)).alias("_m"))
    d = d.select(F.transform("_m", lambda m: chat.message(m["role"], m["content"])).alias("messages"),
                 F.col("_r.temperature").alias("temperature"), F.col("_r.top_k").alias("top_k"), F.col("_r.max_tokens").alias("max_tokens"))
    v = chat.validate_chat_request(d)
    v = v.select(F.when(F.col("messages").isNull(), F.lit(0)).otherwise(F.size("messages")).alias("n_messages"),
                 F.when(F.col("messages").isNull(), F.lit("unreadable")).otherwise(F.col("reason")).alias("reason"))
    q = (v.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    _run(q)
    return q


def stream_mix_counts(spark: SparkSession, src: str, out: str, checkpoint: str,
                      files_per_trigger: int = 1) -> StreamingQuery:
    """Running docs / chars per source; each micro-batch writes the complete totals to a folder of its own."""
    schema = spark.read.parquet(src).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    agg = s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch_id}")  # a rerun of the batch replaces its folder only

    q = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True).start())
    _run(q)
    return q


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """What the last complete batch of ``stream_mix_counts`` wrote."""
    every = spark.read.parquet(out)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


EMA_ROW = "run {0}, event_id long, ts_us long, step long, ema double"
LATE_ROW = "run {0}, event_id long, ts_us long, value double"
STATE_ROW = "run {0}, total double, n long, last_ts long, last_id long"


def _with_state(batch: DataFrame, state: DataFrame, beta: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(EMA rows, late rows, next state) of a micro-batch and the state before it.

    The EMA is a decayed sum, so the batch is summed by itself, a run in many blocks, and what
    the run had before is added, decayed by the number of steps since.
    """
    before = broadcast_if_small(state.withColumnsRenamed({"run": "_r", "total": "_total", "n": "_n"}))
    d = batch.join(before, F.col("run").eqNullSafe(F.col("_r")), "left").drop("_r")
    seen = F.coalesce(F.struct("ts_us", "event_id") <= F.struct("last_ts", "last_id"), F.lit(False))
    late = d.filter(seen).select("run", "event_id", "ts_us", "value")
    d = runs.with_steps(d.filter(~seen).drop("last_ts", "last_id"), "run", ["ts_us", "event_id"], "j")
    d = runs.decayed_sum(d, "run", "j", "value", beta, "_s")
    d = d.withColumn("total", F.col("_s") + F.coalesce("_total", F.lit(0.0)) * F.pow(F.lit(beta), F.col("j") + 1))
    d = d.withColumn("step", F.coalesce("_n", F.lit(0)).cast("long") + F.col("j"))
    d = materialised(d.select("run", "event_id", "ts_us", "step", "total"), "ema-batch")
    ema = d.select("run", "event_id", "ts_us", "step", (F.col("total") * (1 - beta) / (1 - F.pow(F.lit(beta), F.col("step") + 1))).alias("ema"))
    new = d.groupBy("run").agg(F.max_by("total", "step").alias("total"), (F.max("step") + 1).alias("n"),
                               F.max(F.struct("ts_us", "event_id")).alias("l")).select("run", "total", "n", F.col("l.ts_us").alias("last_ts"), F.col("l.event_id").alias("last_id"))
    fresh = new.select(F.col("run").alias("_r"))
    old = state.join(broadcast_if_small(fresh), F.col("run").eqNullSafe(F.col("_r")), "left_anti")
    return ema, late, new.unionByName(old)


def stream_ema(spark: SparkSession, src: str, out: str, checkpoint: str, beta: float = 0.9,
               files_per_trigger: int = 1) -> StreamingQuery:
    """Debiased EMA per run over arriving step metrics (run, event_id, ts_us, value).

    ``out/ema`` gets the values.  A row that is not after the last one of its run, in the order
    of (ts_us, event_id), comes too late for it and goes to ``out/late``.  The state, a row per
    run, is the table that the batch before left in ``out/state``; a rerun of a batch replaces
    its own folders only.
    """
    schema = spark.read.option("recursiveFileLookup", "true").parquet(src).schema
    kind = schema["run"].dataType.simpleString()
    rows = {name: text.format(kind) for name, text in (("ema", EMA_ROW), ("late", LATE_ROW), ("state", STATE_ROW))}
    for name, text in rows.items():
        spark.createDataFrame([], text).write.mode("overwrite").parquet(f"{out}/{name}/batch=-1")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(src)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        state = spark.read.schema(rows["state"]).parquet(f"{out}/state/batch={epoch_id - 1}")
        d = batch.select("run", F.col("event_id").cast("long").alias("event_id"), F.col("ts_us").cast("long").alias("ts_us"), F.col("value").cast("double").alias("value"))
        for name, df in zip(("ema", "late", "state"), _with_state(d, state, beta), strict=True):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={epoch_id}")

    q = s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    _run(q)
    return q


def streamed_ema(spark: SparkSession, out: str, name: str = "ema") -> DataFrame:
    """The rows that ``stream_ema`` wrote to ``out/ema`` or ``out/late``."""
    return spark.read.parquet(f"{out}/{name}").drop("batch")
