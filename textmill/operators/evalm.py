"""Evaluation metrics over token-level score tables.

Model outputs are input data here: per-token negative log-likelihoods or
log-probs arrive as rows, and every metric is a partial + final aggregation
(the distributed analogue of summing per rank and all-reducing).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small, dense_array

LN2 = math.log(2.0)


def token_bytes_lookup(tokens: DataFrame, token_bytes: DataFrame, token: str = "token_id") -> DataFrame:
    """Attach ``n_bytes`` of each token id: an array access, no shuffle on hot token ids."""
    table = dense_array(token_bytes, token, "n_bytes", "_bytes")  # one row
    return tokens.crossJoin(F.broadcast(table)).withColumn("n_bytes", F.get("_bytes", F.col(token).cast("int"))).drop("_bytes")


def bits_per_byte(tok_nll: DataFrame, token_bytes: DataFrame, by: Sequence[str] = (),
                  target: str = "target", nats: str = "nats") -> DataFrame:
    """sum(nats of targets with bytes) / (ln 2 * sum(bytes)); targets < 0 ignored; no bytes -> +inf.

    A group whose targets are all ignored stays, with +inf.
    """
    t = tok_nll.withColumnRenamed(target, "token_id")
    j = token_bytes_lookup(t.withColumn("token_id", F.when(F.col("token_id") >= 0, F.col("token_id"))), token_bytes)
    nb = F.coalesce(F.col("n_bytes"), F.lit(0))
    g = j.groupBy(*by).agg(F.sum(F.when(nb > 0, F.col(nats)).otherwise(F.lit(0.0))).alias("sum_nats"),
                           F.sum(nb).cast("long").alias("sum_bytes"))
    return g.withColumn("bpb", F.when(F.col("sum_bytes") == 0, F.lit(float("inf"))).otherwise(
        F.col("sum_nats") / (F.lit(LN2) * F.col("sum_bytes"))))


def score_continuation(tok_lp: DataFrame, max_len: int, req: Sequence[str], pos: str = "pos",
                       n_cont: str = "n_cont", lp: str = "lp", hit: str = "is_argmax") -> DataFrame:
    """Sum of continuation log-probs and whether every token was the arg-max.

    Over-long inputs keep their last ``max_len`` tokens, so at most
    ``max_len - 1`` continuation tokens (the last ones) are scored.
    """
    scored = F.col(pos) >= F.col(n_cont) - F.least(F.col(n_cont), F.lit(max_len - 1))
    # a request without scored token has log-likelihood 0 and counts as greedy
    return tok_lp.groupBy(*req).agg(F.coalesce(F.sum(F.when(scored, F.col(lp))), F.lit(0.0)).alias("loglik"),
                                    F.coalesce(F.bool_and(F.when(scored, F.col(hit))), F.lit(True)).alias("is_greedy"),
                                    F.count(F.when(scored, 1)).alias("n_scored"))


def rolling_loglik(tok_lp: DataFrame, max_len: int, doc: Sequence[str], pos: str = "pos",
                   lp: str = "lp") -> DataFrame:
    """Split into ``max_len`` chunks; the first token of every chunk is unscored.

    A document without scored token has log-likelihood 0.
    """
    scored = (F.col(pos) % max_len) != 0
    return tok_lp.groupBy(*doc).agg(F.coalesce(F.sum(F.when(scored, F.col(lp))), F.lit(0.0)).alias("loglik"),
                                    F.count(F.when(scored, 1)).alias("n_scored"))


def bits_per_byte_rows(d: DataFrame, token_bytes: DataFrame, by: Sequence[str] = (),
                       targets: str = "targets", nats: str = "nats", token: str = "token_id") -> DataFrame:
    """``bits_per_byte`` of rows that hold arrays: summed inside the row, then once per group."""
    table = dense_array(token_bytes, token, "n_bytes", "_bytes")  # one row
    j = d.crossJoin(F.broadcast(table))
    size = F.transform(targets, lambda t: F.when(t >= 0, F.coalesce(F.get("_bytes", t), F.lit(0))).otherwise(0))
    j = j.withColumn("_size", size)
    used = F.zip_with(F.col(nats), F.col("_size"), lambda x, b: F.when(b > 0, x).otherwise(0.0))
    j = j.select(*by, F.aggregate(used, F.lit(0.0), lambda a, x: a + x).alias("_nats"),
                 F.aggregate("_size", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n"))
    g = j.groupBy(*by).agg(F.coalesce(F.sum("_nats"), F.lit(0.0)).alias("sum_nats"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("sum_bytes"))
    return g.withColumn("bpb", F.when(F.col("sum_bytes") == 0, F.lit(float("inf"))).otherwise(
        F.col("sum_nats") / (F.lit(LN2) * F.col("sum_bytes"))))


def mc_pick(req: DataFrame, question: Sequence[str], choice: str = "choice_id",
            score: str = "loglik") -> DataFrame:
    """Arg-max choice per question; ties go to the lowest choice id."""
    return req.groupBy(*question).agg(
        F.max_by(F.col(choice), F.struct(F.col(score), -F.col(choice))).alias("picked"))


def mc_accuracy(req: DataFrame, question: Sequence[str], task: str, gold: str = "gold",
                choice: str = "choice_id", score: str = "loglik") -> DataFrame:
    picks = mc_pick(req, [*question, task, gold], choice, score)
    return picks.groupBy(task).agg(F.count(F.lit(1)).alias("n"),
                                   F.avg((F.col("picked") == F.col(gold)).cast("double")).alias("accuracy"))


def suite_composite(task_scores: DataFrame, acc: str = "acc", acc_norm: str = "acc_norm",
                    by: Sequence[str] = ()) -> DataFrame:
    """Mean over tasks of ``acc or acc_norm or 0`` (0.0 counts as missing, like Python ``or``)."""
    v = F.coalesce(F.when(F.col(acc) != 0, F.col(acc)), F.when(F.col(acc_norm) != 0, F.col(acc_norm)), F.lit(0.0))
    return task_scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"), F.avg(v).alias("composite"))


def centered_accuracy(acc: DataFrame, baselines: DataFrame, task: str = "task",
                      col: str = "accuracy") -> DataFrame:
    """(acc - b) / (1 - b) with the task's random baseline ``b``."""
    j = acc.join(broadcast_if_small(baselines), task, "left")
    return j.withColumn("centered", (F.col(col) - F.col("baseline")) / (1.0 - F.col("baseline")))


def suite_delta(a: DataFrame, b: DataFrame, task: str = "task", col: str = "accuracy") -> DataFrame:
    """Task-by-task comparison of two runs, including tasks present in only one."""
    return (a.select(task, F.col(col).alias("score_a"))
            .join(b.select(task, F.col(col).alias("score_b")), task, "full_outer")
            .withColumn("delta", F.col("score_b") - F.col("score_a")))


def comparable_tasks(d: DataFrame, k1: str = "k_a", k2: str = "k_b") -> DataFrame:
    """Keep tasks where both evaluations are zero-shot or both are few-shot."""
    return d.filter((F.col(k1) == 0) == (F.col(k2) == 0))


def mc_bias_diagnostics(req: DataFrame, question: Sequence[str], gold: str = "gold",
                        choice: str = "choice_id", score: str = "loglik", length: str = "n_cont") -> DataFrame:
    """Per position: how often it is gold, how often picked, and wrong picks by length vs gold."""
    picks = mc_pick(req, [*question, gold], choice, score)
    lens = req.select(*question, choice, length)
    p = (picks.join(lens.withColumnRenamed(choice, "picked").withColumnRenamed(length, "picked_len"),
                    [*question, "picked"])
         .join(lens.withColumnRenamed(choice, gold).withColumnRenamed(length, "gold_len"), [*question, gold]))
    wrong = F.col("picked") != F.col(gold)
    by_pick = p.groupBy(F.col("picked").alias("position")).agg(
        F.count(F.lit(1)).alias("n_picked"),
        F.count(F.when(wrong & (F.col("picked_len") < F.col("gold_len")), 1)).alias("n_wrong_shorter"),
        F.count(F.when(wrong & (F.col("picked_len") > F.col("gold_len")), 1)).alias("n_wrong_longer"),
        F.count(F.when(wrong & (F.col("picked_len") == F.col("gold_len")), 1)).alias("n_wrong_same"))
    by_gold = p.groupBy(F.col(gold).alias("position")).agg(F.count(F.lit(1)).alias("n_gold"))
    return by_pick.join(by_gold, "position", "full_outer").na.fill(0)
