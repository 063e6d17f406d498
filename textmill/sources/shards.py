"""Text/token shards, chat JSONL, score CSVs and run logs.

Order is data here: every row carries ``(shard_id, row_in_shard)``; on read
they come from the file name order and ``_metadata.row_index``.  Writers go
through Spark's commit protocol (no partial files) and skip shards that
already exist with a left-anti join.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ranking import dense_index
from ..operators.chat import MESSAGE

ROW_GROUP = 1024


def with_shard_position(d: DataFrame, shard: str = "shard_id", key: str = "doc_id") -> DataFrame:
    """``row_in_shard`` = rank of ``key`` within its shard (skew-safe)."""
    return dense_index(d, [key], by=[shard], out="row_in_shard")


def read_text_shards(spark: SparkSession, path: str) -> DataFrame:
    """Parquet shards -> (text, shard_id, row_in_shard); shard order = file-name order; ``.tmp`` ignored."""
    raw = (spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
           .select("text", F.col("_metadata.file_name").alias("file"),
                   F.col("_metadata.row_index").alias("row_in_shard")))
    files = dense_index(raw.select("file").distinct(), ["file"], out="shard_id")
    return raw.join(files, "file").drop("file")


def split_last_shard(d: DataFrame, which: str = "train", shard: str = "shard_id") -> DataFrame:
    """train = all shards but the last; val = the last (a one-row aggregate is broadcast)."""
    last = d.agg(F.max(shard).alias("_last"))
    j = d.crossJoin(F.broadcast(last))  # single-row side
    cond = F.col(shard) < F.col("_last") if which == "train" else F.col(shard) == F.col("_last")
    return j.filter(cond).drop("_last")


def row_group_of(d: DataFrame, size: int = ROW_GROUP, sub: int | None = None) -> DataFrame:
    d = d.withColumn("row_group", (F.col("row_in_shard") / size).cast("long"))
    if sub:
        d = d.withColumn("sub_batch", ((F.col("row_in_shard") % size) / sub).cast("long"))
    return d


def rank_shard(d: DataFrame, rank: int, world: int) -> DataFrame:
    return d.filter(F.pmod(F.col("row_group"), F.lit(world)) == rank)


def resume_after(d: DataFrame, pq: int, rg: int, rank: int, world: int) -> DataFrame:
    """Rows of this rank strictly after position (pq, rg): the next row group of the
    rank is ``(rg // world + 1) * world + rank``; past the end of the shard the scan
    simply continues with the next shard.  ``epochs_after`` adds the epochs that follow."""
    start = (rg // world + 1) * world + rank
    after = (F.col("shard_id") > pq) | ((F.col("shard_id") == pq) & (F.col("row_group") >= start))
    return rank_shard(d.filter(after), rank, world)


def epochs_after(d: DataFrame, epoch: int, pq: int, rg: int, rank: int, world: int, last_epoch: int) -> DataFrame:
    """``resume_after`` in ``epoch``, then the rank's rows of each later epoch, with ``epoch``."""
    rest = resume_after(d, pq, rg, rank, world).withColumn("epoch", F.lit(epoch))
    if last_epoch <= epoch:
        return rest
    later = rank_shard(d, rank, world).withColumn("epoch", F.explode(F.sequence(F.lit(epoch + 1), F.lit(last_epoch))))
    return rest.unionByName(later)


def last_shard(spark: SparkSession, path: str) -> int | None:
    """The largest shard number of a folder of shards: file names are listed, nothing is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return names.agg(F.max(F.regexp_extract("path", r"/shard_id=(\d+)/", 1).try_cast("int"))).first()[0]


def row_groups_of_rank(d: DataFrame, rank: int, world: int, size: int = ROW_GROUP, start: int = 0, terms: int = 64) -> DataFrame:
    """Rows of the row groups ``rank, rank + world, ...`` from group ``start`` on.

    The first ``terms`` groups are ranges of ``row_in_shard``, which the Parquet reader compares
    with its statistics, so that other row groups aren't read; later ones are filtered.
    """
    row = F.col("row_in_shard")
    if world == 1:
        return d.filter(row >= start * size)
    first = start + (rank - start) % world
    groups = [first + k * world for k in range(terms)]
    picked = row >= (groups[-1] + 1) * size
    for g in groups:
        picked = picked | row.between(g * size, g * size + size - 1)
    return d.filter(picked).filter(F.floor(row / size) % world == rank)  # only the first of the two reaches the reader


def scan_text_shards(spark: SparkSession, path: str, split: str | None = "train", rank: int = 0, world: int = 1,
                     size: int = ROW_GROUP, after: tuple[int, int] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """The rows of shards written by ``write_text_shards`` that a rank reads, with ``row_group``.

    ``split``: "train" is all shards but the last, "val" the last, None all.  ``after=(shard, row group)``
    resumes behind a position.  Shards are chosen by their folders and row groups by the
    reader's statistics: what isn't selected is not read.  ``size`` is that of the row groups
    written; ``schema`` saves looking into a file for it.
    """
    if split not in ("train", "val", None):
        raise ValueError("split must be train, val or None")
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    d = (reader.schema(schema) if schema is not None else reader).parquet(path)
    if split:
        last = last_shard(spark, path)
        d = d.filter(F.lit(False) if last is None else F.col("shard_id") < last if split == "train" else F.col("shard_id") == last)
    if after is None:
        return row_group_of(row_groups_of_rank(d, rank, world, size), size)
    pq, rg = after
    rest = row_groups_of_rank(d.filter(F.col("shard_id") == pq), rank, world, size, start=(rg // world + 1) * world)
    later = row_groups_of_rank(d.filter(F.col("shard_id") > pq), rank, world, size)
    return row_group_of(rest.unionByName(later), size)


def skip_done(d: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return d.join(done.select(*keys).distinct(), list(keys), "left_anti")


def missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def existing_shards(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("shard_id").distinct()
    except AnalysisException as e:
        if not missing(e):
            raise
        return None


GROUPS_PER_FILE = 64


def write_text_shards(d: DataFrame, path: str, skip_existing: bool = True, repack: bool = False, row_group: int = ROW_GROUP,
                      columns: Sequence[Column] | None = None) -> None:
    """One folder per shard, zstd, groups of ``row_group`` rows; shards already present are skipped.

    A shard of more than 64 row groups is written by several tasks, a file each.  ``columns`` are
    written instead of those of ``d``, beside ``shard_id`` and ``row_in_shard``; they are made from
    the rows that a task has got, so that texts, not their tokens, are dealt to the tasks.
    ``repack=True`` writes without dictionary encoding or column statistics
    (zstd level 3), as the repackaging variant does.
    """
    spark = d.sparkSession
    if skip_existing:
        done = existing_shards(spark, path)
        if done is not None:
            d = skip_done(d, done, ["shard_id"])
    rows_per_file = GROUPS_PER_FILE * row_group
    part = F.floor(F.col("row_in_shard") / rows_per_file)
    rows = d.repartition("shard_id", part)
    if columns is not None:
        rows = rows.select("shard_id", "row_in_shard", *columns)
    w = (rows.sortWithinPartitions("shard_id", "row_in_shard")
         .write.mode("append").partitionBy("shard_id").option("maxRecordsPerFile", rows_per_file)
         .option("compression", "zstd").option("parquet.block.row.count.limit", row_group))
    if repack:
        w = (w.option("parquet.enable.dictionary", "false").option("parquet.compression.codec.zstd.level", "3")
             .option("parquet.column.statistics.enabled", "false"))
    w.parquet(path)


def shard_summary(d: DataFrame, tokens: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_docs")]
    if tokens:
        aggs.append(F.sum(F.size(tokens)).cast("long").alias("n_tokens"))
    else:
        aggs.append(F.sum(F.length("text")).cast("long").alias("n_chars"))
    return d.groupBy("shard_id").agg(*aggs)


def shard_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of a shard folder (``.tmp`` excluded); content is never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(path).select("path", "length")
    return f.filter(~F.col("path").endswith(".tmp")).agg(F.count(F.lit(1)).alias("n_files"),
                                                         F.sum("length").alias("bytes"))


def scan_tokens_or_text(spark: SparkSession, token_dir: str, text_dir: str) -> DataFrame:
    """Use the token shards when the folder holds any parquet file, else the raw text."""
    try:
        return spark.read.parquet(token_dir).withColumn("source_kind", F.lit("tokens"))
    except AnalysisException as e:
        if not missing(e):
            raise
    return read_text_shards(spark, text_dir).withColumn("source_kind", F.lit("text"))


# --- chat JSONL ----------------------------------------------------------------

def write_chat_jsonl(d: DataFrame, path: str, append: bool = False, metadata: str | None = None) -> None:
    """One JSON array of {role, content} per line (or {messages, metadata} with ``metadata``)."""
    msgs = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    line = F.to_json(msgs) if metadata is None else F.to_json(
        F.struct(msgs.alias("messages"), F.col(metadata).alias("metadata")))
    d.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_chat_jsonl(spark: SparkSession, path: str):
    """Lines -> (conversations, rejects).

    Lines of whitespace are skipped; what is no JSON array of objects with a string ``role``
    and a string ``content`` goes to rejects; a missing path is an empty set, with a warning.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if not missing(e):
            raise
        warnings.warn(f"no chat file at {path}", stacklevel=2)
        raw = spark.createDataFrame([], "value string")
    raw = raw.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("line")).filter(F.col("line") != "")
    kind = F.schema_of_variant(F.try_parse_json("line"))
    shape = kind.startswith("ARRAY<OBJECT<") & kind.contains("content: STRING") & kind.contains("role: STRING")
    parsed = raw.withColumn("_m", F.from_json("line", "array<struct<role:string,content:string>>"))
    whole = F.forall("_m", lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    parsed = parsed.withColumn("_ok", F.coalesce(shape & F.col("_m").isNotNull() & whole, F.lit(False)))
    good = parsed.filter("_ok").select(F.transform("_m", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts"))).cast(f"array<{MESSAGE}>").alias("messages"), "line")
    return good, parsed.filter(~F.col("_ok")).select("line")


# --- CSV and logs ----------------------------------------------------------------

def read_score_csv(spark: SparkSession, path: str) -> DataFrame:
    """``Task, acc, centered`` lines: header skipped, >= 3 cells, blanks -> null, bad rows dropped.

    Of lines for one task the last counts.
    """
    t = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id()).withColumn("_c", F.split("value", ","))
    t = t.filter((F.size("_c") >= 3) & (F.trim(F.col("_c")[0]) != "Task"))
    cell = lambda i: F.nullif(F.trim(F.col("_c")[i]), F.lit(""))
    r = t.select(cell(0).alias("task"), cell(1).try_cast("double").alias("acc"),
                 cell(2).try_cast("double").alias("centered"), cell(1).alias("_a"), cell(2).alias("_b"), "_n")
    bad = (F.col("_a").isNotNull() & F.col("acc").isNull()) | (F.col("_b").isNotNull() & F.col("centered").isNull())
    last = F.max_by(F.struct("acc", "centered"), "_n").alias("_v")
    return r.filter(F.col("task").isNotNull() & ~bad).groupBy("task").agg(last).select("task", "_v.acc", "_v.centered")


# Columns of the scaling-run results file.
RUN_CSV = ("flops_budget,depth,model_dim,params_wte,params_value_embeds,params_lm_head,params_transformer,params_scalars,"
           "params_total,num_iterations,tokens_trained,val_bpb,train_time_sec")
RUN_CSV_SCHEMA = ", ".join(f"{c} {'string' if c == 'flops_budget' else 'double' if c in ('val_bpb', 'train_time_sec') else 'long'}"
                           for c in RUN_CSV.split(","))


def read_run_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results of scaling runs; an empty cell is null, and so is one that doesn't parse."""
    return spark.read.option("header", "true").option("mode", "PERMISSIVE").schema(RUN_CSV_SCHEMA).csv(path)


def append_run_csv(d: DataFrame, path: str) -> None:
    """Append runs whose (flops_budget, depth) the file doesn't have yet; of several new ones the first by value."""
    spark = d.sparkSession
    new = d.select(*RUN_CSV.split(","))
    new = new.groupBy("flops_budget", "depth").agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    try:
        new = skip_done(new, read_run_csv(spark, path), ["flops_budget", "depth"])
    except AnalysisException as e:
        if not missing(e):
            raise
    new.write.mode("append").option("header", "true").csv(path)


def extract_run_metrics(lines: DataFrame, patterns: dict[str, str], run: str = "run",
                        line_no: str = "line_no", text: str = "value", derived: dict[str, str] | None = None) -> DataFrame:
    """Last match per (run, key) of each regex (group 1), commas removed, cast to double; pivoted.

    ``derived`` maps further columns to expressions over the keys.
    """
    parts = []
    for key, pat in patterns.items():
        v = F.regexp_extract(text, pat, 1)
        parts.append(lines.filter(F.col(text).rlike(pat)).select(
            run, line_no, F.lit(key).alias("key"), F.regexp_replace(v, ",", "").try_cast("double").alias("v")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    last = u.groupBy(run, "key").agg(F.max_by("v", line_no).alias("v"))
    wide = last.groupBy(run).pivot("key", list(patterns)).agg(F.max("v"))
    return wide.withColumns({name: F.expr(e) for name, e in (derived or {}).items()})


def extract_section_kv(lines: DataFrame, keys: Sequence[str], section: str = "section",
                       line_no: str = "line_no", text: str = "value") -> DataFrame:
    """Values of the lines that contain a key, anywhere; the last such line wins and the value
    is the text between the first and second ``:`` (lines without one don't count)."""
    named = F.explode(F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.col(text), k))).alias("key")
    kv = lines.select(section, line_no, F.split(F.col(text), ":").alias("_p"), named).filter(F.size("_p") >= 2)
    return kv.groupBy(section, "key").agg(F.max_by(F.trim(F.get("_p", 1)), line_no).alias("value")).select(section, "value", "key")
