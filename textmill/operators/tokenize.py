"""Tokenizers as Column functions, conversation rendering and token statistics.

An *encoder* turns text Columns into ``array<int>`` Columns.  The byte
encoder (ids 0..255 = UTF-8 bytes, then the special tokens) is pure JVM
SQL; the BPE encoder (``operators.bpe``) is an Arrow-batched pandas UDF with
the same interface.  Rendering works inside each row with higher-order
functions: a conversation never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import N_BYTES, SPECIAL_TOKENS, byte_tokens, bytes_to_text, pretokenize
from .chat import PART, merge_system

PART_TYPES = ("text", "python", "python_output")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def utf8_bytes(text: pa.Array) -> pa.Array:
    """UTF-8 bytes of each text: the batch's own buffer, cast once, with the text offsets."""
    data = text.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    body = data.buffers()[2]
    ids = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]].astype(np.int32) if body is not None else np.zeros(0, np.int32)
    if not data.null_count:
        return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(ids))
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(ids), mask=data.is_null())


class ByteEncoder:
    """UTF-8 bytes; specials follow at 256.. in the fixed special-token order."""

    name = "bytes"

    def __init__(self):
        self.n_mergeable = N_BYTES
        self.special = {s: N_BYTES + i for i, s in enumerate(SPECIAL_TOKENS)}
        self.bos = self.special["<|bos|>"]

    def encode(self, text: Column) -> Column:
        return utf8_bytes(text)

    def encode_array(self, arr: Column) -> Column:
        return F.transform(arr, lambda t: byte_tokens(t))

    def encode_array2(self, arr: Column) -> Column:
        return F.transform(arr, lambda a: F.transform(a, lambda t: byte_tokens(t)))

    def count(self, text: Column) -> Column:
        return F.octet_length(text)

    def decode(self, ids: Column) -> Column:
        return bytes_to_text(ids)


def pretoken_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Frequency of every pre-token chunk (partial aggregation before the shuffle)."""
    return df.select(F.explode(pretokenize(text)).alias("chunk")).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"))


def _rep(v: int, n: Column) -> Column:
    return F.array_repeat(F.lit(v), n)


def _render_pieces(enc, messages: Column, content_ids: Column, part_ids: Column) -> Column:
    sp = enc.special

    def one(m, ids, pids):
        n = F.size(ids)
        user = F.struct(F.concat(F.array(F.lit(sp["<|user_start|>"])), ids, F.array(F.lit(sp["<|user_end|>"]))).alias("ids"),
                        _rep(0, n + 2).alias("mask"))
        plain_ids = F.concat(F.array(F.lit(sp["<|assistant_start|>"])), ids, F.array(F.lit(sp["<|assistant_end|>"])))
        plain_mask = F.concat(F.array(F.lit(0)), _rep(1, n), F.array(F.lit(1)))

        def part(p, pi):
            k = F.size(pi)
            return (F.when(p["type"] == "python", F.struct(
                        F.concat(F.array(F.lit(sp["<|python_start|>"])), pi, F.array(F.lit(sp["<|python_end|>"]))).alias("ids"),
                        _rep(1, k + 2).alias("mask")))
                    .when(p["type"] == "python_output", F.struct(
                        F.concat(F.array(F.lit(sp["<|output_start|>"])), pi, F.array(F.lit(sp["<|output_end|>"]))).alias("ids"),
                        _rep(0, k + 2).alias("mask")))
                    .otherwise(F.struct(pi.alias("ids"), _rep(1, k).alias("mask"))))

        parts = F.zip_with(m["parts"], pids, part)
        part_ids_flat = F.flatten(F.transform(parts, lambda x: x["ids"]))
        part_mask_flat = F.flatten(F.transform(parts, lambda x: x["mask"]))
        struct_ids = F.concat(F.array(F.lit(sp["<|assistant_start|>"])), part_ids_flat,
                              F.array(F.lit(sp["<|assistant_end|>"])))
        struct_mask = F.concat(F.array(F.lit(0)), part_mask_flat, F.array(F.lit(1)))
        assistant = F.when(m["parts"].isNull(), F.struct(plain_ids.alias("ids"), plain_mask.alias("mask"))) \
                     .otherwise(F.struct(struct_ids.alias("ids"), struct_mask.alias("mask")))
        return F.when(m["role"] == "user", user).otherwise(assistant)

    return F.zip_with(F.zip_with(messages, content_ids, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                      part_ids, lambda mi, p: one(mi["m"], mi["i"], p))


def render_conversation(d: DataFrame, enc, max_tokens: int = 2048, col: str = "messages") -> DataFrame:
    """(ids, mask) per conversation; invalid conversations get ``reason`` and null ids."""
    m = merge_system(d, col)
    msgs = F.col(col)
    bad = F.get(F.filter(F.transform(msgs, lambda x, i: F.when(
        ~x["role"].eqNullSafe(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))),
        F.concat(F.lit("bad_role:"), i.cast("string"))).when(
        F.exists(F.coalesce(x["parts"], F.array().cast(f"array<{PART}>")), lambda p: ~F.coalesce(p["type"].isin(*PART_TYPES), F.lit(False))),
        F.concat(F.lit("bad_part:"), i.cast("string")))), lambda x: x.isNotNull()), 0)
    reason = (F.when(F.col("merge_reason").isNotNull(), F.col("merge_reason"))
              .when(F.size(msgs) < 1, F.lit("empty"))
              .when(bad.isNotNull(), bad))
    contents = F.transform(msgs, lambda x: F.coalesce(x["content"], F.lit("")))
    parts_text = F.transform(msgs, lambda x: F.coalesce(F.transform(x["parts"], lambda p: p["text"]),
                                                        F.array().cast("array<string>")))
    m = m.withColumn("reason", reason) \
         .withColumn("_cids", enc.encode_array(contents)) \
         .withColumn("_pids", enc.encode_array2(parts_text))
    pieces = _render_pieces(enc, msgs, F.col("_cids"), F.col("_pids"))
    ids = F.concat(F.array(F.lit(enc.bos)), F.flatten(F.transform(pieces, lambda p: p["ids"])))
    mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform(pieces, lambda p: p["mask"])))
    ok = F.col("reason").isNull()
    return (m.withColumn("ids", F.when(ok, F.slice(ids, 1, max_tokens)))
             .withColumn("mask", F.when(ok, F.slice(mask, 1, max_tokens)))
             .drop("_cids", "_pids", "merge_reason"))


def render_for_completion(d: DataFrame, enc, col: str = "messages", max_tokens: int = 2048) -> DataFrame:
    """Drop the final assistant message, render, append assistant_start.

    Conversations that do not end with an assistant message get a reason.
    """
    last_ok = F.get(F.col(col), F.size(col) - 1)["role"] == "assistant"
    d2 = d.withColumn("_last_ok", F.coalesce(last_ok, F.lit(False))).withColumn(
        col, F.when(F.col("_last_ok"), F.slice(col, 1, F.greatest(F.size(col) - 1, F.lit(0)))).otherwise(F.col(col)))
    r = render_conversation(d2, enc, max_tokens, col)
    r = r.withColumn("reason", F.when(~F.col("_last_ok"), F.lit("last_not_assistant")).otherwise(F.col("reason")))
    return r.withColumn("ids", F.when(F.col("reason").isNull(), F.concat(
        "ids", F.array(F.lit(enc.special["<|assistant_start|>"]))))).drop("mask", "_last_ok")


def render_chat_prompt(d: DataFrame, enc, col: str = "messages") -> DataFrame:
    """Serving prompt: no alternation check, no system merge; other roles are skipped."""
    sp = enc.special
    msgs = F.col(col)
    cids = enc.encode_array(F.transform(msgs, lambda x: F.coalesce(x["content"], F.lit(""))))

    def one(x, ids):
        return (F.when(x["role"] == "user", F.concat(F.array(F.lit(sp["<|user_start|>"])), ids,
                                                     F.array(F.lit(sp["<|user_end|>"]))))
                .when(x["role"] == "assistant", F.concat(F.array(F.lit(sp["<|assistant_start|>"])), ids,
                                                          F.array(F.lit(sp["<|assistant_end|>"]))))
                .otherwise(F.array().cast("array<int>")))

    body = F.flatten(F.zip_with(msgs, cids, one))
    return d.withColumn("ids", F.concat(F.array(F.lit(enc.bos)), body,
                                        F.array(F.lit(sp["<|assistant_start|>"]))))


def supervised_share(d: DataFrame, mask: str = "mask") -> DataFrame:
    total = F.size(mask)
    sup = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_supervised", sup).withColumn(
        "supervised_share", F.when(total > 0, sup / total).otherwise(F.lit(0.0)))


def special_ids(enc) -> list[tuple[str, int]]:
    return [(s, enc.n_mergeable + i) for i, s in enumerate(SPECIAL_TOKENS)]


def compression_eval(texts: DataFrame, encoders: dict, group: str, base: str) -> DataFrame:
    """Bytes, tokens and bytes/token per (encoder, group); ``rel_pct`` = token saving vs ``base``.

    ``better`` names the one of the two, encoder or base, with more bytes a token, or is ``tie``.
    All encoders count in one pass over the texts.
    """
    sums = texts.select(F.col(group).alias("group"), F.octet_length("text").cast("long").alias("b"),
                        *[f(F.col("text")).cast("long").alias(f"t{k}") for k, f in enumerate(encoders.values())])
    sums = sums.groupBy("group").agg(F.sum("b").alias("n_bytes"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(len(encoders))])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("encoder"), F.col(f"t{k}").alias("n_tokens")) for k, name in enumerate(encoders)]))
    agg = sums.select("group", "n_bytes", F.col(f"t{list(encoders).index(base)}").alias("_base"), each.alias("_e")).select("group", "n_bytes", "_base", "_e.*")
    better = F.when(F.col("n_tokens") < F.col("_base"), F.col("encoder")).when(F.col("n_tokens") > F.col("_base"), F.lit(base)).otherwise(F.lit("tie"))
    return (agg.withColumn("better", better)
            .withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.col("n_tokens"), 6))
            .withColumn("rel_pct", F.round((F.col("_base") - F.col("n_tokens")) / F.col("_base") * 100.0, 6))
            .drop("_base"))
