"""Chat conversations as ``messages array<struct<role, content, parts>>``.

``content`` holds plain text; ``parts`` (``array<struct<type, text>>``) holds
structured assistant content (``text`` / ``python`` / ``python_output``) and
is null for plain messages.  All operators are higher-order SQL functions
over the array, so a conversation never leaves its row.  Validators return a
``reason`` column (null = valid) instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lang_letter_ratio

# ---------------------------------------------------------------------------
# Chat request limits (first failing rule wins, in this order).
MAX_MESSAGES_PER_REQUEST = 500
MAX_MESSAGE_LENGTH = 8000
MAX_TOTAL_CONVERSATION_LENGTH = 32000
MIN_TEMPERATURE, MAX_TEMPERATURE = 0.0, 2.0
MIN_TOP_K, MAX_TOP_K = 0, 200
MIN_MAX_TOKENS, MAX_MAX_TOKENS = 1, 4096
# Assistant answers are cut to this many characters.
RESPONSE_CAP = 1500
# ---------------------------------------------------------------------------

PART = "struct<type:string,text:string>"
MESSAGE = f"struct<role:string,content:string,parts:array<{PART}>>"


def message(role, content, parts=None) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    p = F.lit(None).cast(f"array<{PART}>") if parts is None else parts
    return F.struct(r.alias("role"), content.alias("content"), p.alias("parts"))


def messages_from_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn",
                        role: str = "role", text: str = "text") -> DataFrame:
    """Exploded turns -> one row per conversation with an ordered messages array."""
    g = turns.groupBy(conv).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("_m"))
    return g.select(conv, F.transform("_m", lambda m: message(m["role"], m["content"])).alias("messages"))


def normalize_messages(d: DataFrame, col: str = "messages") -> DataFrame:
    """Keep user/assistant/system messages whose content is a string; order kept."""
    return d.withColumn(col, F.filter(col, lambda m: m["role"].isin("user", "assistant", "system")
                                       & m["content"].isNotNull() & m["parts"].isNull()))


def instruct_to_messages(d: DataFrame) -> DataFrame:
    """(instruction, input, output) -> [user, assistant]; nulls count as empty."""
    ins = F.coalesce(F.col("instruction"), F.lit(""))
    inp = F.coalesce(F.col("input"), F.lit(""))
    out = F.coalesce(F.col("output"), F.lit(""))
    user = F.when(inp == "", ins).otherwise(F.concat(ins, F.lit("\n\n"), inp))
    return d.withColumn("messages", F.array(message("user", user), message("assistant", out)))


def merge_system(d: DataFrame, col: str = "messages") -> DataFrame:
    """Fold a leading system message into the following user message.

    Adds ``merge_reason`` = 'system_not_followed_by_user' when message 1 is not a user.
    """
    m = F.col(col)
    first, second = F.get(m, 0), F.get(m, 1)
    is_sys = first["role"] == "system"
    ok = second["role"] == "user"
    merged = F.concat(
        F.array(message("user", F.concat(first["content"], F.lit("\n\n"), second["content"]))),
        F.slice(m, 3, F.greatest(F.size(m) - 2, F.lit(0))))
    return (d.withColumn("merge_reason", F.when(is_sys & ~F.coalesce(ok, F.lit(False)),
                                                F.lit("system_not_followed_by_user")))
             .withColumn(col, F.when(is_sys & F.coalesce(ok, F.lit(False)), merged).otherwise(m)))


def _first_problem(arr: Column, fn) -> Column:
    probs = F.filter(F.transform(arr, fn), lambda x: x.isNotNull())
    return F.get(probs, 0)


def validate_training_chat(d: DataFrame, col: str = "messages") -> DataFrame:
    """>=2 messages; role/content present; optional system first; then user/assistant alternate."""
    m = F.col(col)
    has_sys = F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False))
    off = F.when(has_sys, 1).otherwise(0)

    def check(x, i):
        expected = F.when(((i - off) % 2) == 0, F.lit("user")).otherwise(F.lit("assistant"))
        skip = (i == 0) & has_sys
        return (F.when(x["role"].isNull(), F.concat(F.lit("missing_role:"), i.cast("string")))
                .when(x["content"].isNull(), F.concat(F.lit("missing_content:"), i.cast("string")))
                .when(~skip & (x["role"] != expected), F.concat(F.lit("bad_role:"), i.cast("string"))))

    reason = F.when(m.isNull() | (F.size(m) < 2), F.lit("too_short")).otherwise(_first_problem(m, check))
    return d.withColumn("reason", reason)


def validate_synthetic_chat(d: DataFrame, col: str = "messages") -> DataFrame:
    """>=2 messages, strict alternation from user (no system), stripped content non-empty."""
    m = F.col(col)

    def check(x, i):
        expected = F.when((i % 2) == 0, F.lit("user")).otherwise(F.lit("assistant"))
        blank = F.coalesce(x["content"], F.lit("")).rlike(r"(?U)^\s*$")
        return (F.when(~x["role"].eqNullSafe(expected), F.concat(F.lit("bad_role:"), i.cast("string")))
                .when(blank, F.concat(F.lit("empty_content:"), i.cast("string"))))

    reason = F.when(m.isNull() | (F.size(m) < 2), F.lit("too_short")).otherwise(_first_problem(m, check))
    return d.withColumn("reason", reason)


def validate_chat_request(d: DataFrame, col: str = "messages", temperature: str = "temperature",
                          top_k: str = "top_k", max_tokens: str = "max_tokens") -> DataFrame:
    """Serving-side request checks; the first failing rule, in the order written, is the reason."""
    m = F.col(col)
    n = F.size(m)

    def per_msg(x, i):
        return (F.when(F.coalesce(x["content"], F.lit("")) == "", F.concat(F.lit("empty_content:"), i.cast("string")))
                .when(F.length(x["content"]) > MAX_MESSAGE_LENGTH,
                      F.concat(F.lit("message_too_long:"), i.cast("string"))))

    total = F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.length(x["content"]), F.lit(0)))
    bad_role = _first_problem(m, lambda x, i: F.when(~F.coalesce(x["role"].isin("user", "assistant"), F.lit(False)),
                                                     F.concat(F.lit("invalid_role:"), i.cast("string"))))
    t, k, mt = F.col(temperature), F.col(top_k), F.col(max_tokens)
    reason = (F.when(m.isNull() | (n == 0), F.lit("no_messages"))
              .when(n > MAX_MESSAGES_PER_REQUEST, F.lit("too_many_messages"))
              .when(_first_problem(m, per_msg).isNotNull(), _first_problem(m, per_msg))
              .when(total > MAX_TOTAL_CONVERSATION_LENGTH, F.lit("total_too_long"))
              .when(bad_role.isNotNull(), bad_role)
              .when(t.isNotNull() & ~t.between(MIN_TEMPERATURE, MAX_TEMPERATURE), F.lit("bad_temperature"))
              .when(k.isNotNull() & ~k.between(MIN_TOP_K, MAX_TOP_K), F.lit("bad_top_k"))
              .when(mt.isNotNull() & ~mt.between(MIN_MAX_TOKENS, MAX_MAX_TOKENS), F.lit("bad_max_tokens")))
    return d.withColumn("reason", reason)


def assistant_text(col: str = "messages") -> Column:
    return F.array_join(F.transform(F.filter(col, lambda x: x["role"] == "assistant"),
                                    lambda x: F.coalesce(x["content"], F.lit(""))), " ")


def lang_filter_conversations(d: DataFrame, letters: str, threshold: float = 0.005,
                              col: str = "messages") -> DataFrame:
    """Keep non-empty conversations whose joined assistant text has marker share >= threshold."""
    ratio = lang_letter_ratio(assistant_text(col), letters)
    return d.withColumn("lang_ratio", ratio).filter((F.size(col) > 0) & (F.col("lang_ratio") >= threshold))


def inject_system_prompt(d: DataFrame, text: str, col: str = "messages") -> DataFrame:
    m = F.col(col)
    has = F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False))
    return d.withColumn(col, F.when(has, m).otherwise(F.concat(F.array(message("system", F.lit(text))), m)))


def truncate_responses(d: DataFrame, n: int = RESPONSE_CAP, col: str = "messages") -> DataFrame:
    return d.withColumn(col, F.transform(col, lambda x: F.when(
        x["role"] == "assistant", x.withField("content", F.substring(x["content"], 1, n))).otherwise(x)))


def repetition_share(text: Column, n: int = 4) -> Column:
    """Share of duplicated word n-grams: 1 - distinct/total (0 when there are none)."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def share(w: Column) -> Column:
        total = F.size(w) - n + 1
        grams = F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0))),
                            lambda i: F.array_join(F.array(*[F.get(w, i + k) for k in range(n)]), " "))
        return F.when(total <= 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(grams)) / total)
    return F.get(F.transform(F.array(words), share), 0)  # in a lambda, so that the text is split once, not once for each n-gram


def repetition_filter(d: DataFrame, n: int = 4, threshold: float = 0.3, col: str = "messages") -> DataFrame:
    """Drop conversations whose assistant text repeats word n-grams more than ``threshold``."""
    return d.withColumn("rep_share", repetition_share(assistant_text(col), n)).filter(
        F.col("rep_share") <= threshold)
