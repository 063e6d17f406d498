"""Queries: budget shards, character budgets, packing plans and packed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, pack
from ..operators import tokenize as tok
from ..operators.mix import seeded_shuffle
from ..session import materialised
from .fixtures import SEED, table
from .registry import query
from .tokens import BYTES_SQL, RENDER_SQL, rendered

T = 2048
CAP = T + 1
LANE_BUDGET = 500_000  # so that the test tables fill several lanes
SHARD_BUDGET = 100_000


def lanes(d, length):
    return pack.lanes_for(d, length, LANE_BUDGET)


def lane_sql(len_expr: str) -> str:
    """``d``: documents with lane and length; as many lanes as the lengths fill."""
    return f"""d0 AS (SELECT doc_id, {len_expr} AS len FROM documents),
nl AS (SELECT greatest(1, ceil(sum(len) / {LANE_BUDGET}.0))::BIGINT AS n FROM d0),
d AS (SELECT ('0x' || substr(md5(concat_ws('|', {SEED}, doc_id)), 1, 8))::BIGINT % nl.n AS lane, doc_id, len FROM d0, nl)"""


def lists_sql(name: str = "d", key: str = "doc_id") -> str:
    """``l``: of each lane its documents with tokens, in order, as a list of (-length, place)."""
    return f"""o AS (SELECT lane, {key} AS key, len, row_number() OVER (PARTITION BY lane ORDER BY {key}) AS i FROM {name} WHERE len > 0),
l AS (SELECT lane, list({{'neg': -len, 'i': i}} ORDER BY i) AS docs FROM o GROUP BY lane)"""


# Best fit, one placement a step: the buffer is a list, of which the first of the longest that fit
# is the smallest entry, and the first of the shortest the smallest of those with the sign turned.
def bestfit_crop_sql(buffer: int = 1000, batch: int = 128) -> str:
    return f"""{lists_sql()},
s(lane, docs, held, nxt, row, pos, i, "offset", take) AS (
  SELECT lane, docs, []::STRUCT(neg BIGINT, i BIGINT)[], 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM l
  UNION ALL
  SELECT lane, docs, list_filter(held, lambda x: x.i <> best.i), nxt, CASE WHEN pos + cut = {CAP} THEN row + 1 ELSE row END,
         CASE WHEN pos + cut = {CAP} THEN 0 ELSE pos + cut END, best.i, row * {CAP} + pos, cut
  FROM (SELECT *, CASE WHEN fit IS NOT NULL THEN fit ELSE {{'neg': -least_.len, 'i': least_.i}} END AS best,
               CASE WHEN fit IS NOT NULL THEN -fit.neg ELSE {CAP} - pos END AS cut
        FROM (SELECT *, list_min(list_filter(held, lambda x: x.neg >= pos - {CAP})) AS fit,
                     list_min(list_transform(held, lambda x: {{'len': -x.neg, 'i': x.i}})) AS least_
              FROM (SELECT lane, docs, list_concat(held, list_slice(docs, nxt + 1, upto)) AS held, least(upto, len(docs)) AS nxt, row, pos
                    FROM (SELECT *, CASE WHEN len(held) < {buffer} THEN nxt + {batch} * (({buffer} - len(held) + {batch - 1}) // {batch}) ELSE nxt END AS upto FROM s))
              WHERE len(held) > 0))),
p AS (SELECT o.lane, o.key, s."offset" // {CAP} AS row, s."offset" % {CAP} AS "offset", s.take FROM s JOIN o ON o.lane = s.lane AND o.i = s.i)"""


def bestfit_pad_sql(buffer: int, name: str, key: str) -> str:
    return f"""{lists_sql(name, key)},
s(lane, docs, held, nxt, row, pos, i, "offset", take) AS (
  SELECT lane, docs, []::STRUCT(neg BIGINT, i BIGINT)[], 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM l
  UNION ALL
  SELECT lane, docs, CASE WHEN fit IS NULL THEN held ELSE list_filter(held, lambda x: x.i <> fit.i) END, nxt, CASE WHEN fit IS NULL THEN row + 1 ELSE row END,
         CASE WHEN fit IS NULL THEN 0 ELSE pos - fit.neg END, fit.i, row * {CAP} + pos, -fit.neg
  FROM (SELECT *, list_min(list_filter(held, lambda x: x.neg >= pos - {CAP})) AS fit
        FROM (SELECT lane, docs, list_concat(held, list_slice(docs, nxt + 1, upto)) AS held, least(upto, len(docs)) AS nxt, row, pos
              FROM (SELECT *, greatest(nxt, nxt + {buffer} - len(held)) AS upto FROM s))
        WHERE len(held) > 0)),
placed AS (SELECT o.lane, o.key, s."offset" // {CAP} AS row, s."offset" % {CAP} AS "offset", s.take FROM s JOIN o ON o.lane = s.lane AND o.i = s.i)"""


# First fit decreasing, one document a step: the room of each row is a list.
FFD_SQL = f"""o AS (SELECT lane, doc_id AS key, least(len, {CAP}) AS len, row_number() OVER (PARTITION BY lane ORDER BY least(len, {CAP}) DESC, doc_id) AS i FROM d WHERE len > 0),
s(lane, i, room, row, "offset", take) AS (
  SELECT lane, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT lane FROM o)
  UNION ALL
  SELECT lane, i, CASE WHEN spot IS NULL THEN list_append(room, {CAP} - len) ELSE list_transform(room, lambda x, k: CASE WHEN k = spot THEN x - len ELSE x END) END,
         coalesce(spot - 1, len(room)), CASE WHEN spot IS NULL THEN 0 ELSE {CAP} - room[spot] END, len
  FROM (SELECT s.lane, o.i, o.len, s.room, list_min(list_filter(range(1, len(s.room) + 1), lambda k: s.room[k] >= o.len)) AS spot
        FROM s JOIN o ON o.lane = s.lane AND o.i = s.i + 1)),
p AS (SELECT o.lane, o.key, s.row, s."offset", s.take FROM s JOIN o ON o.lane = s.lane AND o.i = s.i)"""

# Sums of the packed rows of documents; each starts with 256, as does its padding.
SUMS_SQL = f"""k AS (SELECT p.*, list_slice(list_prepend(256, {BYTES_SQL}), 1, take) AS toks FROM p JOIN documents ON doc_id = p.key),
g AS (SELECT lane, row, sum(take)::BIGINT AS content_len, sum(list_sum(toks))::BIGINT AS total, arg_max(toks[-1], "offset") AS last FROM k GROUP BY lane, row)
SELECT lane, row, content_len, (total + ({CAP} - content_len) * 256 - CASE WHEN content_len = {CAP} THEN last ELSE 256 END)::BIGINT AS inputs_sum,
       (total + ({CAP} - content_len) * 256 - 256)::BIGINT AS targets_sum FROM g"""
FULL_SQL = f"p AS (SELECT * FROM p0 QUALIFY sum(take) OVER (PARTITION BY lane, row) = {CAP})"  # incomplete rows are dropped


def doc_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))


def doc_tokens(spark, sf_dir):
    enc = tok.ByteEncoder()
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.array(F.lit(enc.bos)), enc.encode(F.col("text"))).alias("tokens"),
        (enc.count(F.col("text")) + 1).cast("long").alias("n_tokens"))  # lengths need no tokens


def _boundary_sql(len_expr: str, budget: int) -> str:
    return f"""{lane_sql(len_expr)},
c AS (SELECT lane, doc_id, len, (sum(len) OVER (PARTITION BY lane ORDER BY doc_id))::BIGINT AS cs FROM d),
b(lane, cs) AS (
  SELECT lane, min(cs) FROM c WHERE cs >= {budget} GROUP BY lane
  UNION ALL
  SELECT b.lane, (SELECT min(c.cs) FROM c WHERE c.lane = b.lane AND c.cs >= b.cs + {budget}) FROM b
  WHERE b.cs IS NOT NULL),
bb AS (SELECT lane, cs FROM b WHERE cs IS NOT NULL),
nc AS (SELECT lane, count(*) AS n_closed FROM bb GROUP BY lane),
s AS (SELECT c.lane, c.doc_id, c.len, c.cs,
        (SELECT count(*) FROM bb WHERE bb.lane = c.lane AND bb.cs < c.cs) AS grp,
        coalesce((SELECT max(bb.cs) FROM bb WHERE bb.lane = c.lane AND bb.cs < c.cs), 0) AS base
      FROM c),
s2 AS (SELECT s.*, coalesce(nc.n_closed, 0) AS n_closed FROM s LEFT JOIN nc ON s.lane = nc.lane)"""


@query("shard_by_budget", oracle=f"""WITH RECURSIVE {_boundary_sql('length(text)', SHARD_BUDGET)},
tails AS (SELECT lane, sum(len) AS tail_chars FROM s2 WHERE grp = n_closed GROUP BY lane)
SELECT s2.doc_id, s2.lane, s2.grp AS shard FROM s2 LEFT JOIN tails t ON s2.lane = t.lane
WHERE s2.grp < s2.n_closed OR t.tail_chars >= {SHARD_BUDGET} * 0.5""")
def q_shard_by_budget(spark, sf_dir):
    d = doc_chars(spark, sf_dir)
    r = pack.shard_by_budget(d, SHARD_BUDGET, "doc_id", "n_chars", n_lanes=lanes(d, "n_chars"), seed=SEED)
    return r.select("doc_id", "lane", "shard")


# One step a document: where its lane's open shard, or row, stands after it.
WALK_SQL = """o AS (SELECT lane, doc_id, len, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS i FROM d)"""


PAD_WALK_SQL = f"""w(lane, doc_id, i, row, pos, take) AS (
  SELECT lane, doc_id, i, 0::BIGINT, 0::BIGINT, least(len, {CAP}) FROM o WHERE i = 1
  UNION ALL
  SELECT o.lane, o.doc_id, o.i, w.row + CASE WHEN w.pos + w.take + least(o.len, {CAP}) > {CAP} THEN 1 ELSE 0 END,
         CASE WHEN w.pos + w.take + least(o.len, {CAP}) > {CAP} THEN 0 ELSE w.pos + w.take END, least(o.len, {CAP})
  FROM w JOIN o ON o.lane = w.lane AND o.i = w.i + 1)"""


@query("shard_by_budget_aligned", oracle=f"""WITH RECURSIVE {lane_sql('length(text)')}, {WALK_SQL},
w(lane, doc_id, i, shard, chars, docs, closed) AS (
  SELECT lane, doc_id, i, 0::BIGINT, len, 1::BIGINT, false FROM o WHERE i = 1
  UNION ALL
  SELECT o.lane, o.doc_id, o.i, CASE WHEN full_ THEN shard + 1 ELSE shard END, CASE WHEN full_ THEN 0 ELSE chars END + o.len,
         CASE WHEN full_ THEN 0 ELSE docs END + 1, false
  FROM (SELECT *, chars >= {SHARD_BUDGET} AND docs % 8 = 0 AS full_ FROM w) x JOIN o ON o.lane = x.lane AND o.i = x.i + 1),
e AS (SELECT lane, shard, max(docs) AS n_docs, max(chars) AS n_chars FROM w GROUP BY lane, shard)
SELECT lane, shard, n_docs, n_chars FROM e WHERE n_chars >= {SHARD_BUDGET} AND n_docs % 8 = 0""")
def q_shard_by_budget_aligned(spark, sf_dir):
    """Row-group aligned shards (doc count a multiple of 8 here; 1024 for real shards); tail dropped."""
    d = doc_chars(spark, sf_dir)
    r = pack.shard_by_budget(d, SHARD_BUDGET, "doc_id", "n_chars", n_lanes=lanes(d, "n_chars"),
                             seed=SEED, keep_tail=None, multiple=8)
    return r.groupBy("lane", "shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("pack_greedy_crop", oracle=f"""WITH RECURSIVE {_boundary_sql('strlen(text) + 1', CAP)}
SELECT doc_id, lane, grp AS row, cs - len - base AS "offset", least(len, {CAP} - (cs - len - base)) AS take
FROM s2 WHERE grp < n_closed""")
def q_pack_greedy_crop(spark, sf_dir):
    d = doc_tokens(spark, sf_dir)
    plan = pack.plan_greedy_crop(d, T, "doc_id", "n_tokens", n_lanes=lanes(d, "n_tokens"), seed=SEED)
    return plan.select(F.col("key").alias("doc_id"), "lane", "row", "offset", "take")


@query("char_budget_sample", oracle="""WITH c AS (SELECT doc_id, length(left(text, 10000)) AS n FROM documents),
p AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
             AS cum_before FROM c)
SELECT doc_id, cum_before FROM p WHERE cum_before <= (SELECT sum(n) / 2 FROM c)""")
def q_char_budget_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    budget = d.agg(F.sum(F.length(F.substring("text", 1, 10000))).alias("s")).first()["s"] / 2
    return filters.char_budget_sample(d, budget, 10000, ["doc_id"]).select("doc_id", "cum_before")


@query("pack_greedy_crop_tail", oracle=f"""WITH RECURSIVE {_boundary_sql('strlen(text) + 1', CAP)}
SELECT doc_id, lane, grp AS row, cs - len - base AS "offset", least(len, {CAP} - (cs - len - base)) AS take FROM s2""")
def q_pack_greedy_crop_tail(spark, sf_dir):
    """Greedy cropping that keeps each lane's last, incomplete row."""
    d = doc_tokens(spark, sf_dir)
    plan = pack.plan_greedy_crop(d, T, "doc_id", "n_tokens", n_lanes=lanes(d, "n_tokens"), seed=SEED, keep_tail=True)
    return plan.select(F.col("key").alias("doc_id"), "lane", "row", "offset", "take")


FLAT_SQL = f"""t AS (SELECT doc_id, strlen(text) + 1 AS n, list_prepend(256, {BYTES_SQL}) AS toks FROM documents),
s AS (SELECT doc_id, toks, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t),
x AS (SELECT doc_id, start, unnest(toks) AS tok, unnest(range(0, len(toks))) AS i FROM s),
p AS (SELECT (start + i) // {CAP} AS row, (start + i) % {CAP} AS j, tok FROM x
      WHERE (start + i) // {CAP} < (SELECT sum(n) // {CAP} FROM t))"""


@query("chunk_flat", oracle=f"""WITH {FLAT_SQL}
SELECT row, count(*) AS n_tokens, sum(tok)::BIGINT AS token_sum, md5(string_agg(tok::VARCHAR, ',' ORDER BY j)) AS tokens_md5 FROM p GROUP BY row""")
def q_chunk_flat(spark, sf_dir):
    rows = pack.chunk_flat(doc_tokens(spark, sf_dir), T, "doc_id", "tokens", "n_tokens")
    return rows.select("row", F.size("tokens").cast("long").alias("n_tokens"),
                       F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("token_sum"),
                       F.md5(F.array_join("tokens", ",")).alias("tokens_md5"))


@query("chunk_flat_tail", oracle=f"""WITH t AS (SELECT doc_id, strlen(text) + 1 AS n FROM documents),
s AS (SELECT sum(n)::BIGINT AS n FROM t)
SELECT unnest(range(0, (n + {CAP - 1}) // {CAP})) AS row, least({CAP}, n - unnest(range(0, (n + {CAP - 1}) // {CAP})) * {CAP}) AS n_tokens FROM s""")
def q_chunk_flat_tail(spark, sf_dir):
    rows = pack.chunk_flat(doc_tokens(spark, sf_dir), T, "doc_id", "tokens", "n_tokens", keep_tail=True)
    return rows.select("row", F.size("tokens").cast("long").alias("n_tokens"))


@query("shift_targets", oracle=f"""WITH {FLAT_SQL}
SELECT row, sum(tok) FILTER (WHERE j < {T})::BIGINT AS inputs_sum, sum(tok) FILTER (WHERE j >= 1)::BIGINT AS targets_sum,
       any_value(tok) FILTER (WHERE j = 1) AS first_target FROM p GROUP BY row""")
def q_shift_targets(spark, sf_dir):
    rows = pack.shift_targets(pack.chunk_flat(doc_tokens(spark, sf_dir), T, "doc_id", "tokens", "n_tokens"))
    s = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("row", s("inputs").alias("inputs_sum"), s("targets").alias("targets_sum"),
                       F.col("targets")[0].alias("first_target"))


@query("rank_conversations", oracle=f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations),
i AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, conv_id)), conv_id) - 1 AS idx FROM c)
SELECT conv_id, (idx % 4)::INT AS rank, idx // 4 AS step FROM i""")
def q_rank_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    idx = seeded_shuffle(c, SEED, ["conv_id"], out="idx")
    return pack.rank_conversations(idx, 4).select("conv_id", "rank", "step")


def _row_summary(rows):
    s = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("lane", "row", "content_len", s("inputs").alias("inputs_sum"),
                       s("targets").alias("targets_sum"))


BESTFIT_CROP_SQL = bestfit_crop_sql().replace("\np AS (", "\np0 AS (") + ",\n" + FULL_SQL


@query("pack_bestfit_crop", oracle=f"WITH RECURSIVE {lane_sql('strlen(text) + 1')}, {BESTFIT_CROP_SQL},\n{SUMS_SQL}")
def q_pack_bestfit_crop(spark, sf_dir):
    d = doc_tokens(spark, sf_dir)
    plan = pack.plan_bestfit_crop(d, T, "doc_id", "n_tokens", n_lanes=lanes(d, "n_tokens"), seed=SEED)
    return _row_summary(pack.assemble_rows(plan, d, T, "doc_id", "tokens", pad_id=tok.ByteEncoder().bos))


@query("pack_greedy_pad", oracle=f"""WITH RECURSIVE {lane_sql('strlen(text) + 1')}, {WALK_SQL},
{PAD_WALK_SQL},
p AS (SELECT lane, doc_id AS key, row, pos AS "offset", take FROM w),
{SUMS_SQL}""")
def q_pack_greedy_pad(spark, sf_dir):
    d = doc_tokens(spark, sf_dir)
    plan = pack.plan_greedy_pad(d, T, "doc_id", "n_tokens", n_lanes=lanes(d, "n_tokens"), seed=SEED)
    return _row_summary(pack.assemble_rows(plan, d, T, "doc_id", "tokens", pad_id=tok.ByteEncoder().bos))


@query("pack_ffd", oracle=f"WITH RECURSIVE {lane_sql('strlen(text) + 1')}, {FFD_SQL},\n{SUMS_SQL}")
def q_pack_ffd(spark, sf_dir):
    d = doc_tokens(spark, sf_dir)
    plan = pack.plan_ffd(d, T, "doc_id", "n_tokens", n_lanes=lanes(d, "n_tokens"), seed=SEED)
    return _row_summary(pack.assemble_rows(plan, d, T, "doc_id", "tokens", pad_id=tok.ByteEncoder().bos))


@query("pack_bestfit_pad", oracle=f"""WITH RECURSIVE {RENDER_SQL},
nl AS (SELECT greatest(1, ceil(sum(n_tokens) / {LANE_BUDGET}.0))::BIGINT AS n FROM r),
e AS (SELECT ('0x' || substr(md5(concat_ws('|', {SEED}, conv_id)), 1, 8))::BIGINT % nl.n AS lane, conv_id, n_tokens AS len FROM r, nl),
{bestfit_pad_sql(100, 'e', 'conv_id')}
SELECT lane, row, sum(take)::BIGINT AS content_len, sum(n_supervised)::BIGINT AS n_trained FROM placed JOIN r ON r.conv_id = placed.key GROUP BY lane, row""")
def q_pack_bestfit_pad(spark, sf_dir):
    """Rendered conversations (cut to T tokens) packed with padding; masked targets."""
    r = rendered(spark, sf_dir, max_tokens=T).filter(F.col("reason").isNull()).withColumn(
        "n_tokens", F.size("ids").cast("long"))
    plan = pack.plan_bestfit_pad(r, T, "conv_id", "n_tokens", n_lanes=lanes(r, "n_tokens"), seed=SEED).drop("content_len")
    rows = pack.assemble_rows(plan, r, T, "conv_id", "ids", pad_id=tok.ByteEncoder().bos, mask="mask")
    return rows.select("lane", "row", "content_len",
                       F.size(F.filter("targets", lambda t: t >= 0)).cast("long").alias("n_trained"))


def _stats_sql(name: str, ctes: str) -> str:
    return f"""SELECT '{name}' AS packer, rows, round(used / (rows * {CAP}) * 100.0, 4) AS util_pct, round((total - used) / total * 100.0, 4) AS crop_pct,
       round((rows * {CAP} - used) / (rows * {CAP}) * 100.0, 4) AS pad_pct, round(over_ / total * 100.0, 4) AS floor_pct
FROM (WITH RECURSIVE {lane_sql('strlen(text) + 1')}, {ctes}
      SELECT (SELECT count(*) FROM (SELECT DISTINCT lane, row FROM p)) AS rows, (SELECT sum(take) FROM p) AS used, (SELECT sum(len) FROM d) AS total,
             (SELECT sum(greatest(len - {CAP}, 0)) FROM d) AS over_)"""


GREEDY_CROP_SQL = f"""{_boundary_sql('strlen(text) + 1', CAP).split("AS lane, doc_id, len FROM d0, nl)," + chr(10))[1]},
p AS (SELECT lane, grp AS row, least(len, {CAP} - (cs - len - base)) AS take FROM s2 WHERE grp < n_closed)"""
GREEDY_PAD_SQL = f"""{WALK_SQL}, {PAD_WALK_SQL},
p AS (SELECT lane, row, take FROM w)"""


@query("packing_stats", oracle=" UNION ALL ".join(_stats_sql(n, c) for n, c in (
    ("bestfit_crop", BESTFIT_CROP_SQL), ("greedy_crop", GREEDY_CROP_SQL), ("greedy_pad", GREEDY_PAD_SQL), ("ffd", FFD_SQL))))
def q_packing_stats(spark, sf_dir):
    d = materialised(doc_tokens(spark, sf_dir).select("doc_id", "n_tokens"), "packing-lengths")  # every plan reads them
    n = lanes(d, "n_tokens")
    out = None
    for name, planner in (("bestfit_crop", pack.plan_bestfit_crop), ("greedy_crop", pack.plan_greedy_crop),
                          ("greedy_pad", pack.plan_greedy_pad), ("ffd", pack.plan_ffd)):
        s = pack.packing_stats(planner(d, T, "doc_id", "n_tokens", n_lanes=n, seed=SEED), d, T, "doc_id", "n_tokens", name)
        out = s if out is None else out.unionByName(s)
    return out
