"""Queries: pre-tokenisation, byte tokenizer, conversation rendering, compression."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.text import DOC_CAP, SPECIAL_TOKENS, pretokenize
from ..operators import chat
from ..operators import tokenize as tok
from ..session import ensure_checkpoint_dir
from ..sources.shards import missing
from .fixtures import table
from .registry import query

# DuckDB (RE2) form of the split pattern: no look-ahead or possessive marks.
# A U+E000 sentinel is inserted before the last whitespace of a run that is
# followed by a word, which is what ``\s+(?!\S)`` achieves in the original.
RE2_PATTERN = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x{E000}]?\p{L}+|\p{N}{1,2}|"""
               r""" ?[^\s\p{L}\p{N}\x{E000}]+[\r\n]*|\s*[\r\n]|\s+""")


def sql_pretokens(text_sql: str) -> str:
    marked = (f"regexp_replace({text_sql}, '(\\s)([^\\S\\r\\n]\\S)', '\\1' || chr(57344) || '\\2', 'g')")
    return f"regexp_extract_all({marked}, '{RE2_PATTERN.replace(chr(39), chr(39) * 2)}')"


def sql_str(s: str) -> str:
    """SQL literal with control characters spelled as chr()."""
    out, buf = [], ""
    for ch in s:
        if ch in "\t\r\n\x0b\x0c":
            if buf:
                out.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            out.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not out:
        out.append("'" + buf.replace("'", "''") + "'")
    return " || ".join(out)


# Whitespace and digit edge cases appended to the documents.
EDGE_TEXTS = [
    "Hello  world", "tab\t\tbefore word", "line\r\nbreak", "  leading", "trailing  ",
    "x   1", "It's 12345 they'll WE'RE", "a\n\n b", "punct!!! ?? ...", "mixed \t\n word",
    "numbers 1 22 333 4444", "a \tb", "end\n", "  \n  x", "can't-stop, won't_stop",
]
EDGE_SQL = " UNION ALL ".join(
    f"SELECT {-(i + 1)}::BIGINT AS doc_id, {sql_str(t)} AS text" for i, t in enumerate(EDGE_TEXTS))


def docs_with_edges(spark, sf_dir):
    edges = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(EDGE_TEXTS)], "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(edges)


@query("pretokenize", oracle=f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {EDGE_SQL}),
p AS (SELECT doc_id, {sql_pretokens('text')} AS chunks FROM d)
SELECT doc_id, len(chunks)::BIGINT AS n_chunks, md5(array_to_string(chunks, chr(1))) AS chunks_md5 FROM p""")
def q_pretokenize(spark, sf_dir):
    d = docs_with_edges(spark, sf_dir).withColumn("chunks", pretokenize("text"))
    return d.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"),
                    F.md5(F.array_join("chunks", "\u0001")).alias("chunks_md5"))


@query("pretoken_counts", oracle=f"""
SELECT chunk, count(*) AS n FROM (SELECT unnest({sql_pretokens('text')}) AS chunk FROM documents) GROUP BY chunk""")
def q_pretoken_counts(spark, sf_dir):
    return tok.pretoken_counts(table(spark, sf_dir, "documents"))


BYTES_SQL = "list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(text), 2 * i + 1, 2))::INT)"


@query("byte_tokenize", oracle=f"""
SELECT doc_id, strlen(text) + 1 AS n_tokens, (256 + coalesce(list_sum({BYTES_SQL}), 0))::BIGINT AS token_sum,
       md5(array_to_string(list_prepend(256, {BYTES_SQL}), ',')) AS tokens_md5
FROM documents""")
def q_byte_tokenize(spark, sf_dir):
    enc = tok.ByteEncoder()
    d = table(spark, sf_dir, "documents").withColumn(
        "tokens", F.concat(F.array(F.lit(enc.bos)), enc.encode(F.col("text"))))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                    F.md5(F.array_join("tokens", ",")).alias("tokens_md5"))


def rendered(spark, sf_dir, max_tokens=2048):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    return tok.render_conversation(c, tok.ByteEncoder(), max_tokens)


# Ids of the byte tokenizer: bos 256, user start and end 257 and 258, assistant start and end 259 and 260.
MERGED_SQL = f"""c AS (SELECT conv_id, bool_or(turn = 0 AND role = 'system') AS has_sys, max(turn) AS last_turn, arg_max(role, turn) AS last_role,
             any_value(text) FILTER (WHERE turn = 0) AS t0 FROM conversations GROUP BY conv_id),
m AS (SELECT t.conv_id, t.turn, c.last_turn, c.last_role, t.turn - CASE WHEN c.has_sys THEN 1 ELSE 0 END AS i, t.role,
             CASE WHEN c.has_sys AND t.turn = 1 THEN c.t0 || chr(10) || chr(10) || t.text ELSE t.text END AS text
      FROM conversations t JOIN c ON t.conv_id = c.conv_id WHERE NOT (c.has_sys AND t.turn = 0)),
p AS (SELECT *, CASE WHEN role = 'user' THEN list_concat([257], {BYTES_SQL}, [258]) ELSE list_concat([259], {BYTES_SQL}, [260]) END AS ids,
             list_transform(range(0, strlen(text) + 2), lambda x: CASE WHEN role = 'assistant' AND x > 0 THEN 1 ELSE 0 END) AS mask FROM m)"""
RENDER_SQL = f"""{MERGED_SQL},
v AS (SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok,
             list_slice(list_concat([256], flatten(list(ids ORDER BY i))), 1, 2048) AS ids,
             list_slice(list_concat([0], flatten(list(mask ORDER BY i))), 1, 2048) AS mask FROM p GROUP BY conv_id),
r AS (SELECT conv_id, len(ids) AS n_tokens, list_sum(mask)::BIGINT AS n_supervised, md5(array_to_string(ids, ',')) AS ids_md5,
             md5(array_to_string(mask, ',')) AS mask_md5 FROM v WHERE ok)"""


@query("render_conversation", oracle=f"WITH {RENDER_SQL} SELECT conv_id, n_tokens, n_supervised, ids_md5, mask_md5 FROM r")
def q_render_conversation(spark, sf_dir):
    r = rendered(spark, sf_dir).filter(F.col("reason").isNull())
    return r.select("conv_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_supervised"),
                    F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5(F.array_join("mask", ",")).alias("mask_md5"))


PART_TURNS = [
    (-1, [("user", "2+2?", None), ("assistant", None, [("text", "sum: "), ("python", "2+2"), ("python_output", "4"), ("text", " four")])]),
    (-2, [("user", "q", None), ("assistant", None, [("image", "x")])]),
    (-3, [(None, "q", None), ("assistant", "a", None)]),
    (-4, [("system", "s", None), ("assistant", "a", None)]),
    (-5, []),
]


def part_conversations(spark, sf_dir):
    """Answers of the conversations as structured parts: text, code, its output, and more text; and bad ones."""
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    typed = F.array(*[F.struct(F.lit(t).alias("type"), x.alias("text")) for t, x in (
        ("text", F.lit("so: ")), ("python", F.lit("1+1")), ("python_output", F.lit("2")))])
    answer = lambda m: F.when(m["role"] == "assistant", chat.message("assistant", F.lit(None).cast("string"), F.concat(
        typed, F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text")))))).otherwise(m)
    good = c.select("conv_id", F.transform("messages", answer).alias("messages"))
    return good.unionByName(spark.createDataFrame(PART_TURNS, f"conv_id long, messages array<{chat.MESSAGE}>"))


@query("render_parts", oracle=f"""WITH {MERGED_SQL.replace("list_concat([259], " + BYTES_SQL + ", [260])",
    "list_concat([259, 115, 111, 58, 32, 261, 49, 43, 49, 262, 263, 50, 264], " + BYTES_SQL + ", [260])")},
k AS (SELECT *, CASE WHEN role = 'user' THEN mask ELSE list_concat([0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0], list_slice(mask, 2, len(mask))) END AS mk FROM p),
v AS (SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok,
             list_slice(list_concat([256], flatten(list(ids ORDER BY i))), 1, 2048) AS ids,
             list_slice(list_concat([0], flatten(list(mk ORDER BY i))), 1, 2048) AS mask FROM k GROUP BY conv_id)
SELECT conv_id, NULL AS reason, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(mask, ',')) AS mask_md5 FROM v WHERE ok
UNION ALL SELECT -1, NULL, md5('256,257,50,43,50,63,258,259,115,117,109,58,32,261,50,43,50,262,263,52,264,32,102,111,117,114,260'),
                 md5('0,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,0,0,0,1,1,1,1,1,1')
UNION ALL SELECT -2, 'bad_part:1', NULL, NULL UNION ALL SELECT -3, 'bad_role:0', NULL, NULL
UNION ALL SELECT -4, 'system_not_followed_by_user', NULL, NULL UNION ALL SELECT -5, 'empty', NULL, NULL""")
def q_render_parts(spark, sf_dir):
    r = tok.render_conversation(part_conversations(spark, sf_dir), tok.ByteEncoder())
    r = r.filter(F.col("reason").isNull() | (F.col("conv_id") < 0))
    return r.select("conv_id", "reason", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5(F.array_join("mask", ",")).alias("mask_md5"))


@query("supervised_share", oracle=f"""WITH {RENDER_SQL}
SELECT conv_id, n_supervised, round(n_supervised / n_tokens, 6) AS supervised_share FROM r""")
def q_supervised_share(spark, sf_dir):
    r = tok.supervised_share(rendered(spark, sf_dir).filter(F.col("reason").isNull()))
    return r.select("conv_id", "n_supervised", F.round("supervised_share", 6).alias("supervised_share"))


@query("render_for_completion", oracle=f"""WITH {MERGED_SQL},
v AS (SELECT conv_id, bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok,
             list_slice(list_concat([256], flatten(list(ids ORDER BY i))), 1, 2048) AS ids
      FROM p WHERE last_role = 'assistant' AND turn < last_turn GROUP BY conv_id)
SELECT conv_id, len(ids) + 1 AS n_tokens, md5(array_to_string(list_append(ids, 259), ',')) AS ids_md5 FROM v WHERE ok""")
def q_render_for_completion(spark, sf_dir):
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    r = tok.render_for_completion(c, tok.ByteEncoder()).filter(F.col("reason").isNull())
    return r.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("render_chat_prompt", oracle=f"""WITH p AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN list_concat([257], {BYTES_SQL}, [258])
             WHEN role = 'assistant' THEN list_concat([259], {BYTES_SQL}, [260]) ELSE []::INT[] END AS ids FROM conversations),
g AS (SELECT conv_id, list_concat([256], flatten(list(ids ORDER BY turn)), [259]) AS ids, count(*) FILTER (WHERE role = 'user') AS n_user
      FROM p GROUP BY conv_id)
SELECT conv_id, len(ids) AS n_tokens, n_user, md5(array_to_string(ids, ',')) AS ids_md5 FROM g""")
def q_render_chat_prompt(spark, sf_dir):
    enc = tok.ByteEncoder()
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    r = tok.render_chat_prompt(c, enc)
    us = enc.special["<|user_start|>"]
    return r.select("conv_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.size(F.filter("ids", lambda i: i == us)).cast("long").alias("n_user"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


SPECIALS_SQL = ", ".join(f"('{s}', {256 + i})" for i, s in enumerate(SPECIAL_TOKENS))


@query("special_ids", oracle=f"""WITH s(name, id) AS (VALUES {SPECIALS_SQL}),
k AS (SELECT count(DISTINCT conv_id) AS n_conv, count(*) FILTER (WHERE role = 'user') AS n_user,
             count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations)
SELECT s.name, s.id, (CASE s.name WHEN '<|bos|>' THEN k.n_conv WHEN '<|user_start|>' THEN k.n_user
   WHEN '<|user_end|>' THEN k.n_user WHEN '<|assistant_start|>' THEN k.n_assistant + k.n_conv
   WHEN '<|assistant_end|>' THEN k.n_assistant ELSE 0 END)::BIGINT AS n_occurrences FROM s, k""")
def q_special_ids(spark, sf_dir):
    """Special ids (n_mergeable + i) and how often each occurs in the rendered prompts."""
    enc = tok.ByteEncoder()
    c = chat.messages_from_turns(table(spark, sf_dir, "conversations"))
    ids = tok.render_chat_prompt(c, enc).select(F.explode("ids").alias("id")).filter(F.col("id") >= 256)
    counts = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n_occurrences"))
    specials = spark.createDataFrame(tok.special_ids(enc), "name string, id int")
    return specials.join(counts, "id", "left").select(
        "name", "id", F.coalesce("n_occurrences", F.lit(0)).cast("long").alias("n_occurrences"))


@query("roundtrip_check", oracle=f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL {EDGE_SQL})
SELECT count(*) AS n_docs, count(*) FILTER (WHERE array_to_string({sql_pretokens('text')}, '') <> text) AS n_pretoken_mismatch,
       0::BIGINT AS n_byte_mismatch FROM d""")
def q_roundtrip_check(spark, sf_dir):
    enc = tok.ByteEncoder()
    d = docs_with_edges(spark, sf_dir)
    back = enc.decode(enc.encode(F.col("text")))
    return d.agg(F.count(F.lit(1)).alias("n_docs"),
                 F.count(F.when(F.array_join(pretokenize("text"), "") != F.col("text"), 1)).alias("n_pretoken_mismatch"),
                 F.count(F.when(back != F.col("text"), 1)).alias("n_byte_mismatch"))


# --- byte-level BPE -----------------------------------------------------------
BPE_VOCAB = 32_768  # bytes, merges and special tokens: the reference's vocabulary
BPE_BUDGET = 10_000_000_000  # characters of capped documents that the model may be trained on


def bpe_model(spark, sf_dir):
    """(vocabulary, merges) trained on the capped documents, kept in the shared folder of this application."""
    from ..operators import bpe, filters
    path = f"{ensure_checkpoint_dir(spark)}/bpe-{BPE_VOCAB}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    try:
        return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")
    except AnalysisException as e:
        if not missing(e):
            raise
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = filters.char_budget_sample(d, BPE_BUDGET, DOC_CAP, ["doc_id"]).select(F.col("capped").alias("text"))
    vocab, merges = bpe.bpe_train(tok.pretoken_counts(sample), BPE_VOCAB)
    merges.write.parquet(f"{path}/merges")
    vocab.write.parquet(f"{path}/vocab")  # read first, so written last
    return vocab, merges


@query("bpe_train")
def q_bpe_train(spark, sf_dir):
    _, merges = bpe_model(spark, sf_dir)
    return merges


# Public vocabularies: their paths are parameters, and nothing of them is kept here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def bpe_sql(texts: str, path: str, p: str = "") -> str:
    """``{p}ids``: of each text (doc_id, text) the list of its ids, and ``{p}enc``: of each distinct chunk.

    Tokens are hex strings.  A step merges in each chunk the pair of the lowest rank, the leftmost of equals.
    """
    return f"""{p}ranks AS (SELECT hex(from_base64(t)) AS h, r FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})),
{p}cut AS (SELECT doc_id, {sql_pretokens('text')} AS chunks FROM {texts}),
{p}pieces AS (SELECT DISTINCT hex(encode(unnest(chunks))) AS piece FROM {p}cut),
{p}merge(piece, toks, n) AS (
  SELECT piece, CASE WHEN h IS NOT NULL THEN [piece] ELSE list_transform(range(0, len(piece) // 2), lambda i: substr(piece, 2 * i + 1, 2)) END,
         CASE WHEN h IS NOT NULL THEN 0 ELSE 1 END
  FROM {p}pieces LEFT JOIN {p}ranks ON h = piece
  UNION ALL
  SELECT piece, list_concat(list_append(list_slice(toks, 1, (best & 1048575) - 1), toks[best & 1048575] || toks[(best & 1048575) + 1]),
                            list_slice(toks, (best & 1048575) + 2, len(toks))), n + 1
  FROM (SELECT piece, any_value(toks) AS toks, any_value(n) AS n, min(r::BIGINT * 1048576 + i) AS best
        FROM (SELECT piece, toks, n, unnest(range(1, len(toks))) AS i FROM {p}merge WHERE n > 0) x JOIN {p}ranks ON h = toks[i] || toks[i + 1] GROUP BY piece)),
{p}last AS (SELECT piece, arg_max(toks, n) AS toks FROM {p}merge GROUP BY piece),
{p}flat AS (SELECT piece, unnest(toks) AS h, unnest(range(0, len(toks))) AS j FROM {p}last),
{p}enc AS (SELECT piece, list(r ORDER BY j) AS ids FROM {p}flat JOIN {p}ranks USING (h) GROUP BY piece),
{p}parts AS (SELECT doc_id, unnest(chunks) AS chunk, unnest(range(0, len(chunks))) AS k FROM {p}cut),
{p}ids AS (SELECT doc_id, flatten(list(ids ORDER BY k)) AS ids FROM {p}parts JOIN {p}enc ON piece = hex(encode(chunk)) GROUP BY doc_id)"""


@query("bpe_encode", oracle=f"""WITH RECURSIVE {bpe_sql('documents', VOCABULARY)}
SELECT d.doc_id, strlen(text)::BIGINT AS n_bytes, coalesce(len(ids), 0)::BIGINT AS n_tokens, md5(coalesce(array_to_string(ids, ','), '')) AS ids_md5
FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id""")
def q_bpe_encode(spark, sf_dir, vocabulary=VOCABULARY):
    """Ids of whole texts in a public vocabulary of 50,256 tokens."""
    from ..operators.bpe import BPEEncoder
    enc = BPEEncoder.from_file(spark, vocabulary)
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ids", enc.encode(F.col("text")))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("bpe_decode", oracle=f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM ({EDGE_SQL})), {bpe_sql('d', VOCABULARY)}
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_tokens, md5(text) AS decoded_md5 FROM d LEFT JOIN ids ON ids.doc_id = d.doc_id""")
def q_bpe_decode(spark, sf_dir, vocabulary=VOCABULARY):
    """Texts that their ids decode to, and how many ids: with fewer than bytes the round trip says something."""
    from ..operators.bpe import BPEEncoder
    enc = BPEEncoder.from_file(spark, vocabulary)
    d = docs_with_edges(spark, sf_dir).withColumn("ids", enc.encode(F.col("text")))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(enc.decode(F.col("ids"))).alias("decoded_md5"))


@query("compression_eval", oracle=f"""WITH RECURSIVE {bpe_sql('documents', VOCABULARY, 'a_')},
{bpe_sql('documents', VOCABULARY_MULTI, 'm_')},
e AS (SELECT 'bytes' AS encoder, lang AS "group", strlen(text) AS b, strlen(text) AS t FROM documents
  UNION ALL SELECT 'pretokens', lang, strlen(text), len({sql_pretokens('text')}) FROM documents
  UNION ALL SELECT 'bpe_50k', lang, strlen(text), coalesce(len(ids), 0) FROM documents LEFT JOIN a_ids USING (doc_id)
  UNION ALL SELECT 'bpe_multi_50k', lang, strlen(text), coalesce(len(ids), 0) FROM documents LEFT JOIN m_ids USING (doc_id)),
a AS (SELECT encoder, "group", sum(b)::BIGINT AS n_bytes, sum(t)::BIGINT AS n_tokens FROM e GROUP BY ALL)
SELECT a.encoder, a."group", a.n_bytes, a.n_tokens, round(a.n_bytes / a.n_tokens, 6) AS bytes_per_token,
       round((b.n_tokens - a.n_tokens) / b.n_tokens * 100.0, 6) AS rel_pct,
       CASE WHEN a.n_bytes / a.n_tokens > b.n_bytes / b.n_tokens THEN a.encoder WHEN a.n_bytes / a.n_tokens < b.n_bytes / b.n_tokens THEN b.encoder ELSE 'tie' END AS better
FROM a LEFT JOIN a b ON a."group" = b."group" AND b.encoder = 'bpe_50k'""")
def q_compression_eval(spark, sf_dir, base=VOCABULARY, other=VOCABULARY_MULTI):
    """Two public vocabularies, bytes and chunks: the first vocabulary is the base."""
    from ..operators.bpe import BPEEncoder
    d = table(spark, sf_dir, "documents").select("text", "lang")
    encoders = {"bytes": lambda t: F.octet_length(t), "pretokens": lambda t: F.size(pretokenize(t)),
                "bpe_50k": BPEEncoder.from_file(spark, base).count, "bpe_multi_50k": BPEEncoder.from_file(spark, other).count}
    return tok.compression_eval(d, encoders, "lang", "bpe_50k")


@query("token_bytes_table")
def q_token_bytes_table(spark, sf_dir):
    from ..operators.bpe import token_bytes_table
    vocab, _ = bpe_model(spark, sf_dir)
    return token_bytes_table(vocab)


@query("token_byte_stats")
def q_token_byte_stats(spark, sf_dir):
    from ..operators.bpe import token_byte_stats, token_bytes_table
    vocab, _ = bpe_model(spark, sf_dir)
    return token_byte_stats(token_bytes_table(vocab))
