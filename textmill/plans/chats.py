"""Queries: chat conversion, normalisation, validation and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import render_mc
from ..operators import chat
from ..operators.tools import verify_tool_outputs
from .fixtures import table
from .registry import query

# Malformed conversations appended to the real ones so every rule fires.
BAD_TURNS = [
    (-1, 0, "user", "Hei"),
    (-2, 0, "user", "a"), (-2, 1, "user", "b"),
    (-3, 0, "user", ""), (-3, 1, "assistant", "x"),
    (-4, 0, "robot", "hi"), (-4, 1, "assistant", "x"),
    (-5, 0, "system", "be brief"), (-5, 1, "assistant", "x"),
    (-6, 0, "user", "   "), (-6, 1, "assistant", "ok"),
    (-7, 0, "tool", "out"), (-7, 1, "user", "q"), (-7, 2, "assistant", None),
    (-8, 0, None, "who?"), (-8, 1, "assistant", "x"),
    (-9, 0, "user", "\n\t"), (-9, 1, "assistant", "ok"),
]
BAD_SQL = ", ".join(
    "({}, {}, {}, {})".format(c, t, *["NULL" if v is None else "'" + v.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in (r, x)])
    for c, t, r, x in BAD_TURNS)
TURNS_SQL = ("turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL "
             f"SELECT * FROM (VALUES {BAD_SQL}) v(conv_id, turn, role, text))")


def turns(spark, sf_dir):
    bad = spark.createDataFrame(BAD_TURNS, "conv_id long, turn long, role string, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(bad)


def convs(spark, sf_dir):
    return chat.messages_from_turns(turns(spark, sf_dir))


@query("validate_training_chat", oracle=f"""WITH {TURNS_SQL},
c AS (SELECT conv_id, count(*) AS n, bool_or(turn = 0 AND role = 'system') AS has_sys FROM turns GROUP BY conv_id),
p AS (SELECT t.conv_id, t.turn,
        CASE WHEN t.role IS NULL THEN 'missing_role:' || t.turn
             WHEN t.text IS NULL THEN 'missing_content:' || t.turn
             WHEN NOT (t.turn = 0 AND c.has_sys)
                  AND t.role <> CASE WHEN (t.turn - CASE WHEN c.has_sys THEN 1 ELSE 0 END) % 2 = 0
                                     THEN 'user' ELSE 'assistant' END
             THEN 'bad_role:' || t.turn END AS prob
      FROM turns t JOIN c ON t.conv_id = c.conv_id)
SELECT c.conv_id, CASE WHEN c.n < 2 THEN 'too_short' ELSE f.reason END AS reason
FROM c LEFT JOIN (SELECT conv_id, arg_min(prob, turn) AS reason FROM p WHERE prob IS NOT NULL GROUP BY conv_id) f
ON c.conv_id = f.conv_id""")
def q_validate_training_chat(spark, sf_dir):
    return chat.validate_training_chat(convs(spark, sf_dir)).select("conv_id", "reason")


@query("validate_synthetic_chat", oracle=f"""WITH {TURNS_SQL},
c AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
p AS (SELECT conv_id, turn,
        CASE WHEN role IS DISTINCT FROM CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END THEN 'bad_role:' || turn
             WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'empty_content:' || turn END AS prob FROM turns)
SELECT c.conv_id, CASE WHEN c.n < 2 THEN 'too_short' ELSE f.reason END AS reason
FROM c LEFT JOIN (SELECT conv_id, arg_min(prob, turn) AS reason FROM p WHERE prob IS NOT NULL GROUP BY conv_id) f
ON c.conv_id = f.conv_id""")
def q_validate_synthetic_chat(spark, sf_dir):
    return chat.validate_synthetic_chat(convs(spark, sf_dir)).select("conv_id", "reason")


def request_params(df):
    """Sampling parameters derived from the id; some are out of range, some missing."""
    cid = F.col("conv_id")
    miss = (cid % 13) == 0
    return (df.withColumn("temperature", F.when(miss, None).otherwise((cid % 7) * 0.4))
              .withColumn("top_k", F.when(miss, None).otherwise((cid % 5) * 60))
              .withColumn("max_tokens", F.when(miss, None).otherwise((cid % 11) * 500)))


REQ_PARAMS_SQL = """CASE WHEN conv_id % 13 = 0 THEN NULL ELSE (conv_id % 7) * 0.4 END AS temperature,
       CASE WHEN conv_id % 13 = 0 THEN NULL ELSE (conv_id % 5) * 60 END AS top_k,
       CASE WHEN conv_id % 13 = 0 THEN NULL ELSE (conv_id % 11) * 500 END AS max_tokens"""

REQUEST_SQL = f"""{TURNS_SQL},
c AS (SELECT conv_id, count(*) AS n, sum(coalesce(length(text), 0)) AS total,
        arg_min(CASE WHEN coalesce(text, '') = '' THEN 'empty_content:' || turn
                     ELSE 'message_too_long:' || turn END, turn)
          FILTER (WHERE coalesce(text, '') = '' OR length(text) > 8000) AS pm,
        arg_min('invalid_role:' || turn, turn)
          FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) AS br,
        {REQ_PARAMS_SQL}
      FROM turns GROUP BY conv_id),
checked AS (SELECT conv_id, CASE WHEN n = 0 THEN 'no_messages' WHEN n > 500 THEN 'too_many_messages'
     WHEN pm IS NOT NULL THEN pm WHEN total > 32000 THEN 'total_too_long' WHEN br IS NOT NULL THEN br
     WHEN temperature IS NOT NULL AND NOT (temperature BETWEEN 0.0 AND 2.0) THEN 'bad_temperature'
     WHEN top_k IS NOT NULL AND NOT (top_k BETWEEN 0 AND 200) THEN 'bad_top_k'
     WHEN max_tokens IS NOT NULL AND NOT (max_tokens BETWEEN 1 AND 4096) THEN 'bad_max_tokens' END AS reason
FROM c)"""


@query("validate_chat_request", oracle=f"WITH {REQUEST_SQL} SELECT conv_id, reason FROM checked")
def q_validate_chat_request(spark, sf_dir):
    return chat.validate_chat_request(request_params(convs(spark, sf_dir))).select("conv_id", "reason")


GERMAN_MARKS = "äöüßÄÖÜ"


@query("lang_filter_conversations", oracle=f"""WITH a AS (
  SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS t
  FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, CASE WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) = 0 THEN 0.0
        ELSE length(regexp_replace(t, '[^{GERMAN_MARKS}]', '', 'g'))
             / length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) END AS ratio FROM a)
SELECT conv_id, round(ratio, 6) AS lang_ratio FROM r WHERE ratio >= 0.005""")
def q_lang_filter_conversations(spark, sf_dir):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    return chat.lang_filter_conversations(c, GERMAN_MARKS, 0.005).select(
        "conv_id", F.round("lang_ratio", 6).alias("lang_ratio"))


@query("normalize_messages", oracle=f"""WITH {TURNS_SQL}
SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant', 'system') AND text IS NOT NULL) AS n_messages,
       coalesce(string_agg(role, ',' ORDER BY turn)
                FILTER (WHERE role IN ('user', 'assistant', 'system') AND text IS NOT NULL), '') AS roles
FROM turns GROUP BY conv_id""")
def q_normalize_messages(spark, sf_dir):
    d = chat.normalize_messages(convs(spark, sf_dir))
    return d.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


def instruction_rows(spark, sf_dir):
    """Consecutive (user, assistant) turns as instruction rows; input varies with the id."""
    t = table(spark, sf_dir, "conversations")
    u = t.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = t.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    cid = F.col("conv_id")
    return u.join(a, ["conv_id", "turn"]).withColumn(
        "input", F.when(cid % 3 == 0, None).when(cid % 3 == 1, "").otherwise(
            F.concat(F.lit("Context "), cid.cast("string"))))


@query("instruct_to_messages", oracle="""WITH p AS (
  SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output,
         CASE WHEN u.conv_id % 3 = 0 THEN NULL WHEN u.conv_id % 3 = 1 THEN '' ELSE 'Context ' || u.conv_id END AS input
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn,
       CASE WHEN coalesce(input, '') = '' THEN coalesce(instruction, '')
            ELSE coalesce(instruction, '') || chr(10) || chr(10) || input END AS user_content,
       length(coalesce(output, '')) AS assistant_chars
FROM p""")
def q_instruct_to_messages(spark, sf_dir):
    d = chat.instruct_to_messages(instruction_rows(spark, sf_dir))
    return d.select("conv_id", "turn", F.col("messages")[0]["content"].alias("user_content"),
                    F.length(F.col("messages")[1]["content"]).cast("long").alias("assistant_chars"))


@query("merge_system", oracle=f"""WITH {TURNS_SQL},
c AS (SELECT conv_id, count(*) AS n,
        any_value(role) FILTER (WHERE turn = 0) AS r0, any_value(text) FILTER (WHERE turn = 0) AS t0,
        any_value(role) FILTER (WHERE turn = 1) AS r1, any_value(text) FILTER (WHERE turn = 1) AS t1
      FROM turns GROUP BY conv_id)
SELECT conv_id,
  CASE WHEN r0 = 'system' AND r1 = 'user' THEN n - 1 ELSE n END AS n_messages,
  CASE WHEN r0 = 'system' AND r1 = 'user' THEN 'user' ELSE r0 END AS first_role,
  CASE WHEN r0 = 'system' AND r1 = 'user' THEN length(t0) + 2 + length(t1) ELSE length(t0) END AS first_chars,
  CASE WHEN r0 = 'system' AND coalesce(r1, '') <> 'user' THEN 'system_not_followed_by_user' END AS merge_reason
FROM c""")
def q_merge_system(spark, sf_dir):
    d = chat.merge_system(convs(spark, sf_dir))
    first = F.col("messages")[0]
    return d.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                    first["role"].alias("first_role"), F.length(first["content"]).cast("long").alias("first_chars"),
                    "merge_reason")


SYSTEM_PROMPT = "You are a helpful assistant."


@query("inject_system_prompt", oracle=f"""
SELECT conv_id, CASE WHEN bool_or(turn = 0 AND role = 'system') THEN count(*) ELSE count(*) + 1 END AS n_messages,
       CASE WHEN bool_or(turn = 0 AND role = 'system') THEN max(length(text)) FILTER (WHERE turn = 0)
            ELSE {len(SYSTEM_PROMPT)} END AS system_chars
FROM conversations GROUP BY conv_id""")
def q_inject_system_prompt(spark, sf_dir):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    d = chat.inject_system_prompt(c, SYSTEM_PROMPT)
    return d.select("conv_id", F.size("messages").cast("long").alias("n_messages"),
                    F.length(F.col("messages")[0]["content"]).cast("long").alias("system_chars"))


@query("truncate_responses", oracle="""
SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN least(length(text), 1500) ELSE length(text) END)::BIGINT AS total_chars,
       coalesce(max(CASE WHEN role = 'assistant' THEN least(length(text), 1500) END), 0) AS max_assistant_chars
FROM conversations GROUP BY conv_id""")
def q_truncate_responses(spark, sf_dir):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    d = chat.truncate_responses(c, 1500)
    lens = F.transform("messages", lambda m: F.length(m["content"]).cast("long"))
    ass = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"),
                      lambda m: F.length(m["content"]).cast("long"))
    return d.select("conv_id", F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x).alias("total_chars"),
                    F.coalesce(F.array_max(ass), F.lit(0).cast("long")).alias("max_assistant_chars"))


@query("repetition_filter", oracle="""WITH a AS (
  SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS t
  FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, list_filter(string_split_regex(trim(t), '\\s+'), lambda x: x <> '') AS words FROM a),
g AS (SELECT conv_id, len(words) - 3 AS total,
        list_transform(range(0, greatest(len(words) - 3, 0)), lambda i: array_to_string(words[i + 1:i + 4], ' ')) AS grams
      FROM w),
s AS (SELECT conv_id, CASE WHEN total <= 0 THEN 0.0 ELSE 1.0 - len(list_distinct(grams)) / total END AS share FROM g)
SELECT conv_id, round(share, 6) AS rep_share FROM s WHERE share <= 0.001""")
def q_repetition_filter(spark, sf_dir):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    return chat.repetition_filter(c, 4, 0.001).select("conv_id", F.round("rep_share", 6).alias("rep_share"))


LETTERS = ["A", "B", "C", "D"]


def mc_choices(text):
    """The four quarters of a text."""
    n = F.length(text)
    cut = lambda k: F.floor(n * k / 4).cast("int")
    return F.array(*[F.substring(text, cut(k) + 1, cut(k + 1) - cut(k)) for k in range(4)])


MC_SQL = " || ".join(f"'- ' || substr(text, 1 + {k} * length(text) // 4, {k + 1} * length(text) // 4 - {k} * length(text) // 4) || '={x}' || chr(10)"
                     for k, x in enumerate(LETTERS))


@query("render_mc", oracle=f"""
SELECT item_id, 'Multiple Choice question: ' || text || chr(10) || {MC_SQL}
  || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt
FROM benchmark""")
def q_render_mc(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return b.select("item_id", render_mc(F.col("text"), letters, mc_choices(F.col("text"))).alias("prompt"))


TOOL_SQL = """t AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS letters FROM conversations WHERE role = 'assistant'),
v AS (SELECT *, (turn + 3) * 2 - conv_id / 4 AS sum_, length(left(letters, 40)) - length(replace(left(letters, 40), 'e', '')) AS e_ FROM t)"""


def tool_conversations(spark, sf_dir):
    """Assistant turns as calls: a sum, a letter count over the turn's text, and four that fail; some outputs are wrong."""
    t = table(spark, sf_dir, "conversations")
    letters = F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 40)
    total = ((F.col("turn") + 3) * 2 - F.col("conv_id") / 4).cast("string")
    count = (F.length(letters) - F.length(F.replace(letters, F.lit("e"), F.lit("")))).cast("string")
    call = lambda expr, out: [F.struct(F.lit("python").alias("type"), expr.alias("text")), F.struct(F.lit("python_output").alias("type"), out.alias("text"))]
    parts = [*call(F.concat(F.lit("("), F.col("turn").cast("string"), F.lit(" + 3) * 2 - "), F.format_string("%,d", "conv_id"), F.lit(" / 4")),
                   F.when(F.col("conv_id") % 5 == 0, F.lit("0.123")).otherwise(total)),
             *call(F.concat(F.lit("'"), letters, F.lit("'.count('e')")), F.when(F.col("turn") % 3 == 0, F.lit("-1")).otherwise(count)),
             *call(F.lit("2 ** 3"), F.lit("8")), *call(F.lit("1 / (2 - 2)"), F.lit("0")), *call(F.lit("(1 + 2"), F.lit("3")), *call(F.lit("open('x').count('y')"), F.lit("0")),
             F.struct(F.lit("python").alias("type"), F.lit("7 // 2").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("3").alias("text"))]
    part = F.when(F.col("role") == "assistant", F.array(*parts))
    entry = F.struct(F.col("turn").alias("o"), chat.message(F.col("role"), F.col("text"), part).alias("m"))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["m"]).alias("messages"))


@query("verify_tool_outputs", oracle=f"""WITH {TOOL_SQL}
SELECT c.conv_id, 7 * count(v.turn) AS n_calls, 4 * count(v.turn) AS n_refused, count(v.turn) AS n_unanswered,
       coalesce(sum(CASE WHEN CASE WHEN v.conv_id % 5 = 0 THEN 0.123 ELSE sum_ END <> sum_ THEN 1 ELSE 0 END
                  + CASE WHEN CASE WHEN v.turn % 3 = 0 THEN -1 ELSE e_ END <> e_ THEN 1 ELSE 0 END), 0)::BIGINT AS n_mismatched
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v ON v.conv_id = c.conv_id GROUP BY c.conv_id""")
def q_verify_tool_outputs(spark, sf_dir):
    return verify_tool_outputs(tool_conversations(spark, sf_dir)).drop("messages")
