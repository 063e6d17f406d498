"""Queries: bits per byte, continuation scoring, multiple-choice accuracy and suites.

Model scores are deterministic md5 draws: per-token nats ``10 * u(doc, pos)``
over the byte tokens of ``documents``; per-choice continuation log-probs over
``benchmark`` items with four choices cut from the item text, gold =
``item_id mod 4`` and task = ``item_id mod 3``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_places
from ..functions.text import BOS
from ..operators import evalm
from ..operators import tokenize as tok
from .fixtures import SEED, table
from .registry import query
from .tokens import BYTES_SQL

U_SQL = "(('0x' || substr(md5(concat_ws('|', {args})), 1, 8))::BIGINT / 4294967296.0)"


def u_sql(*args) -> str:
    return U_SQL.format(args=", ".join(str(a) for a in args))


def token_bytes_table(spark):
    """Byte tokenizer vocabulary: ids 0..255 have one byte, specials none."""
    enc = tok.ByteEncoder()
    n = enc.n_mergeable + len(enc.special)
    return spark.range(n).select(F.col("id").cast("int").alias("token_id"),
                                 F.when(F.col("id") < 256, 1).otherwise(0).alias("n_bytes"))


def doc_tokens(spark, sf_dir):
    enc = tok.ByteEncoder()
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.posexplode(F.concat(F.array(F.lit(BOS)), enc.encode(F.col("text")))).alias("pos", "tok"))


TOKENS = 1 << 18  # of a batch, one document more at most


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and nats of each document that has a text, in batches of about TOKENS tokens."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        part = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) // TOKENS
        for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            some = batch.slice(int(rows[0]) if len(rows) else 0, len(rows))
            some = some.filter(pc.is_valid(some.column("text")))
            texts = some.column("text").to_pylist()
            ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
            toks = np.empty(ends[-1], np.int32)
            toks[ends[:-1]] = BOS
            body = np.ones(len(toks), bool)
            body[ends[:-1]] = False
            toks[body] = np.frombuffer(b"".join(texts), np.uint8)
            nats = uniform_places(SEED, some.column("doc_id").to_pylist(), np.diff(ends)) * 10.0
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (toks, nats)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("lang"), *lists], ["doc_id", "lang", "toks", "nats"])


def doc_token_nll(spark, sf_dir):
    """``doc_tokens`` with nats, ``10 * uniform(SEED, doc_id, pos)``, drawn a batch at a time."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "lang", F.col("text").cast("binary").alias("text"))
    d = d.mapInArrow(_drawn, "doc_id long, lang string, toks array<int>, nats array<double>")
    d = d.select("doc_id", "lang", "nats", F.posexplode("toks").alias("pos", "tok"))
    return d.select("doc_id", "lang", "pos", "tok", F.get("nats", F.col("pos")).alias("nats"))


DOC_TOK_SQL = f"""t AS (SELECT doc_id, lang, unnest(list_prepend(256, {BYTES_SQL})) AS tok,
                        unnest(range(0, strlen(text) + 1)) AS pos FROM documents),
n AS (SELECT doc_id, lang, tok, pos, {u_sql(SEED, 'doc_id', 'pos')} * 10.0 AS nats FROM t)"""


def doc_nats(spark, sf_dir):
    """Documents with byte targets and nats as arrays; the nats are a formula of id, place and byte."""
    enc = tok.ByteEncoder()
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", enc.encode(F.col("text")).alias("targets"))
    nats = F.transform("targets", lambda t, i: ((F.col("doc_id") * 31 + i * 17 + t * 7) % 1000) / 100.0)
    return d.withColumn("nats", nats)


@query("bits_per_byte", oracle=f"""WITH t AS (SELECT doc_id, lang, unnest({BYTES_SQL}) AS tok, unnest(range(0, strlen(text))) AS pos FROM documents),
n AS (SELECT lang, ((doc_id * 31 + pos * 17 + tok * 7) % 1000) / 100.0 AS nats FROM t)
SELECT lang, count(*) AS sum_bytes, round(sum(nats) / (ln(2) * count(*)), 6) AS bpb FROM n GROUP BY lang""")
def q_bits_per_byte(spark, sf_dir):
    r = evalm.bits_per_byte_rows(doc_nats(spark, sf_dir), token_bytes_table(spark), by=["lang"])
    return r.select("lang", "sum_bytes", F.round("bpb", 6).alias("bpb"))


@query("bits_per_byte_tokens", oracle=f"""WITH {DOC_TOK_SQL}
SELECT lang, count(*) AS sum_bytes, round(sum(nats) / (ln(2) * count(*)), 6) AS bpb FROM n WHERE pos >= 1 GROUP BY lang
UNION ALL SELECT 'ignored', 0, 'inf'::DOUBLE""")
def q_bits_per_byte_tokens(spark, sf_dir):
    """From one row per token; a group whose targets are all ignored stays."""
    t = doc_token_nll(spark, sf_dir).filter(F.col("pos") >= 1).withColumnRenamed("tok", "target")
    none = doc_tokens(spark, sf_dir).filter(F.col("pos") >= 1).limit(3).withColumn("nats", uniform(SEED, "doc_id", "pos") * 10.0)
    none = none.select("doc_id", F.lit("ignored").alias("lang"), "pos", F.lit(-1).alias("target"), "nats")
    r = evalm.bits_per_byte(t.unionByName(none), token_bytes_table(spark), by=["lang"])
    return r.select("lang", "sum_bytes", F.round("bpb", 6).alias("bpb"))


@query("token_bytes_lookup", oracle="""
SELECT doc_id, strlen(text)::BIGINT AS n_bytes, 1::BIGINT AS n_special FROM documents""")
def q_token_bytes_lookup(spark, sf_dir):
    t = doc_tokens(spark, sf_dir).withColumnRenamed("tok", "token_id")
    j = evalm.token_bytes_lookup(t, token_bytes_table(spark))
    return j.groupBy("doc_id").agg(F.sum("n_bytes").cast("long").alias("n_bytes"),
                                   F.count(F.when(F.col("n_bytes") == 0, 1)).alias("n_special"))


@query("rolling_loglik", oracle=f"""WITH {DOC_TOK_SQL}
SELECT doc_id, round(coalesce(sum(-nats) FILTER (WHERE pos % 512 <> 0), 0), 4) AS loglik, count(*) FILTER (WHERE pos % 512 <> 0) AS n_scored
FROM n GROUP BY doc_id""")
def q_rolling_loglik(spark, sf_dir):
    t = doc_token_nll(spark, sf_dir).withColumn("lp", -F.col("nats"))
    r = evalm.rolling_loglik(t, 512, ["doc_id"])
    return r.select("doc_id", F.round("loglik", 4).alias("loglik"), "n_scored")


MAX_LEN = 12


def choice_tokens(spark, sf_dir):
    """Per (item, choice, pos): the continuation's token log-prob and arg-max flag.

    The choices are the four quarters of the item's text.
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ch = b.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("choice_id"), "text")
    ch = ch.withColumn("choice", F.expr("substring(text, 1 + choice_id * length(text) div 4, (choice_id + 1) * length(text) div 4 - choice_id * length(text) div 4)"))
    ch = ch.withColumn("n_cont", F.octet_length("choice").cast("long"))
    enc = tok.ByteEncoder()
    t = ch.select("item_id", "choice_id", "n_cont", F.posexplode(enc.encode(F.col("choice"))).alias("pos", "tok"))
    return (t.withColumn("lp", -10.0 * uniform(SEED, "item_id", "choice_id", "pos"))
             .withColumn("is_argmax", uniform(SEED + 1, "item_id", "choice_id", "pos") < 0.7))


def scored_requests(spark, sf_dir):
    s = evalm.score_continuation(choice_tokens(spark, sf_dir), MAX_LEN, ["item_id", "choice_id", "n_cont"])
    return (s.withColumn("gold", (F.col("item_id") % 4).cast("int"))
             .withColumn("task", (F.col("item_id") % 3).cast("int"))
             .withColumn("loglik_norm", F.col("loglik") / F.col("n_scored")))


CHOICE_SQL = f"""ch AS (SELECT item_id, c AS choice_id, substr(text, 1 + c * length(text) // 4, (c + 1) * length(text) // 4 - c * length(text) // 4) AS choice
         FROM benchmark, (SELECT unnest(range(0, 4)) AS c)),
ct AS (SELECT item_id, choice_id, strlen(choice) AS n_cont,
              unnest(range(0, strlen(choice))) AS pos FROM ch),
tl AS (SELECT *, -10.0 * {u_sql(SEED, 'item_id', 'choice_id', 'pos')} AS lp,
              {u_sql(SEED + 1, 'item_id', 'choice_id', 'pos')} < 0.7 AS is_argmax FROM ct),
sc AS (SELECT item_id, choice_id, n_cont, sum(lp) AS loglik, bool_and(is_argmax) AS is_greedy, count(*) AS n_scored
       FROM tl WHERE pos >= n_cont - least(n_cont, {MAX_LEN - 1}) GROUP BY item_id, choice_id, n_cont),
rq AS (SELECT *, (item_id % 4)::INT AS gold, (item_id % 3)::INT AS task, loglik / n_scored AS loglik_norm FROM sc),
pk AS (SELECT item_id, task, gold, choice_id AS picked FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loglik DESC, choice_id) AS rn FROM rq) WHERE rn = 1),
pkn AS (SELECT item_id, task, gold, choice_id AS picked FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY loglik_norm DESC, choice_id) AS rn FROM rq) WHERE rn = 1),
acc AS (SELECT task, count(*) AS n, avg((picked = gold)::INT::DOUBLE) AS accuracy FROM pk GROUP BY task),
accn AS (SELECT task, avg((picked = gold)::INT::DOUBLE) AS accuracy FROM pkn GROUP BY task)"""


@query("score_continuation", oracle=f"""WITH {CHOICE_SQL}
SELECT item_id, choice_id, round(loglik, 6) AS loglik, is_greedy, n_scored FROM sc""")
def q_score_continuation(spark, sf_dir):
    s = scored_requests(spark, sf_dir)
    return s.select("item_id", "choice_id", F.round("loglik", 6).alias("loglik"), "is_greedy", "n_scored")


@query("mc_accuracy", oracle=f"WITH {CHOICE_SQL} SELECT task, n, round(accuracy, 6) AS accuracy FROM acc")
def q_mc_accuracy(spark, sf_dir):
    a = evalm.mc_accuracy(scored_requests(spark, sf_dir), ["item_id"], "task")
    return a.select("task", "n", F.round("accuracy", 6).alias("accuracy"))


def task_scores(spark, sf_dir):
    req = scored_requests(spark, sf_dir)
    a = evalm.mc_accuracy(req, ["item_id"], "task").select("task", F.col("accuracy").alias("acc"))
    an = evalm.mc_accuracy(req, ["item_id"], "task", score="loglik_norm").select(
        "task", F.col("accuracy").alias("acc_norm"))
    return a.join(an, "task")


@query("suite_composite", oracle=f"""WITH {CHOICE_SQL}
SELECT count(*) AS n_tasks, round(avg(coalesce(nullif(a.accuracy, 0), nullif(b.accuracy, 0), 0.0)), 6) AS composite
FROM acc a JOIN accn b ON a.task = b.task""")
def q_suite_composite(spark, sf_dir):
    r = evalm.suite_composite(task_scores(spark, sf_dir))
    return r.select("n_tasks", F.round("composite", 6).alias("composite"))


def baselines(spark, sf_dir):
    """Random-guess baseline per task: 1 / number of choices."""
    req = scored_requests(spark, sf_dir)
    return req.groupBy("task").agg((1.0 / F.count_distinct("choice_id")).alias("baseline"))


BASE_SQL = "bl AS (SELECT task, 1.0 / count(DISTINCT choice_id) AS baseline FROM rq GROUP BY task)"


@query("baseline_lookup", oracle=f"""WITH {CHOICE_SQL}, {BASE_SQL}
SELECT a.task, round(a.accuracy, 6) AS accuracy, bl.baseline FROM acc a LEFT JOIN bl ON a.task = bl.task""")
def q_baseline_lookup(spark, sf_dir):
    a = evalm.mc_accuracy(scored_requests(spark, sf_dir), ["item_id"], "task")
    j = a.join(baselines(spark, sf_dir), "task", "left")
    return j.select("task", F.round("accuracy", 6).alias("accuracy"), "baseline")


@query("centered_accuracy", oracle=f"""WITH {CHOICE_SQL}, {BASE_SQL},
c AS (SELECT a.task, (a.accuracy - bl.baseline) / (1.0 - bl.baseline) AS centered FROM acc a JOIN bl ON a.task = bl.task)
SELECT task, round(centered, 6) AS centered, (SELECT round(avg(centered), 6) FROM c) AS composite FROM c""")
def q_centered_accuracy(spark, sf_dir):
    a = evalm.mc_accuracy(scored_requests(spark, sf_dir), ["item_id"], "task")
    c = evalm.centered_accuracy(a, baselines(spark, sf_dir))
    comp = c.agg(F.round(F.avg("centered"), 6).alias("composite"))
    return c.select("task", F.round("centered", 6).alias("centered")).crossJoin(comp)  # single-row side


def run_b(spark, sf_dir):
    req = scored_requests(spark, sf_dir).withColumn("task", (F.col("item_id") % 4).cast("int"))
    return evalm.mc_accuracy(req, ["item_id"], "task", score="loglik_norm")


RUNB_SQL = """accb AS (SELECT item_id % 4 AS task, avg((picked = gold)::INT::DOUBLE) AS accuracy FROM pkn GROUP BY 1)"""


@query("suite_delta", oracle=f"""WITH {CHOICE_SQL}, {RUNB_SQL}
SELECT coalesce(a.task, b.task) AS task, round(a.accuracy, 6) AS score_a, round(b.accuracy, 6) AS score_b,
       round(b.accuracy - a.accuracy, 6) AS delta
FROM acc a FULL OUTER JOIN accb b ON a.task = b.task""")
def q_suite_delta(spark, sf_dir):
    a = evalm.mc_accuracy(scored_requests(spark, sf_dir), ["item_id"], "task")
    d = evalm.suite_delta(a, run_b(spark, sf_dir))
    return d.select("task", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"),
                    F.round("delta", 6).alias("delta"))


@query("comparable_tasks", oracle=f"""WITH {CHOICE_SQL}, {RUNB_SQL},
k AS (SELECT coalesce(a.task, b.task) AS task, (coalesce(a.task, b.task) % 2) * 5 AS k_a,
             CASE WHEN coalesce(a.task, b.task) % 3 = 0 THEN 0 ELSE 3 END AS k_b
      FROM acc a FULL OUTER JOIN accb b ON a.task = b.task)
SELECT task, k_a, k_b FROM k WHERE (k_a = 0) = (k_b = 0)""")
def q_comparable_tasks(spark, sf_dir):
    a = evalm.mc_accuracy(scored_requests(spark, sf_dir), ["item_id"], "task")
    d = evalm.suite_delta(a, run_b(spark, sf_dir))
    d = d.withColumn("k_a", (F.col("task") % 2) * 5).withColumn(
        "k_b", F.when(F.col("task") % 3 == 0, 0).otherwise(3))
    return evalm.comparable_tasks(d).select("task", "k_a", "k_b")


@query("mc_bias_diagnostics", oracle=f"""WITH {CHOICE_SQL},
p AS (SELECT pk.*, r1.n_cont AS picked_len, r2.n_cont AS gold_len FROM pk
      JOIN rq r1 ON r1.item_id = pk.item_id AND r1.choice_id = pk.picked
      JOIN rq r2 ON r2.item_id = pk.item_id AND r2.choice_id = pk.gold),
bp AS (SELECT picked AS position, count(*) AS n_picked,
         count(*) FILTER (WHERE picked <> gold AND picked_len < gold_len) AS n_wrong_shorter,
         count(*) FILTER (WHERE picked <> gold AND picked_len > gold_len) AS n_wrong_longer,
         count(*) FILTER (WHERE picked <> gold AND picked_len = gold_len) AS n_wrong_same FROM p GROUP BY picked),
bg AS (SELECT gold AS position, count(*) AS n_gold FROM p GROUP BY gold)
SELECT coalesce(bp.position, bg.position) AS position, coalesce(n_picked, 0) AS n_picked,
       coalesce(n_wrong_shorter, 0) AS n_wrong_shorter, coalesce(n_wrong_longer, 0) AS n_wrong_longer,
       coalesce(n_wrong_same, 0) AS n_wrong_same, coalesce(n_gold, 0) AS n_gold
FROM bp FULL OUTER JOIN bg ON bp.position = bg.position""")
def q_mc_bias_diagnostics(spark, sf_dir):
    return evalm.mc_bias_diagnostics(scored_requests(spark, sf_dir), ["item_id"])
