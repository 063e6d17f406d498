"""Queries: source filter, weighted interleave, epochs, permutations, task mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DOC_CAP, doc_cap, lang_letter_ratio
from ..operators import filters, mix
from ..session import materialised
from .fixtures import FILTERED_SQL, SEED, scores, source_docs, spec_df, table
from .registry import query


def filtered_docs(spark, sf_dir):
    return filters.source_filter(source_docs(spark, sf_dir), spec_df(spark), scores(spark, sf_dir))


def interleaved(spark, sf_dir):
    """Twice as many draws as documents; what the draws need of a document is kept, not its text."""
    docs = materialised(filtered_docs(spark, sf_dir).select("doc_id", "shard", "source", "n_chars"), "mix-docs")
    n_draws = 2 * docs.count()
    return docs, mix.weighted_interleave(docs, spec_df(spark), n_draws, seed=SEED)


@query("source_filter", oracle=f"""WITH {FILTERED_SQL}
SELECT doc_id, shard, source, n_chars FROM filtered""")
def q_source_filter(spark, sf_dir):
    return filtered_docs(spark, sf_dir).select("doc_id", "shard", "source", "n_chars")


@query("source_filter_fields", oracle=f"""WITH {FILTERED_SQL}
SELECT doc_id, source, md5(text) AS text_md5 FROM filtered WHERE shard <> 'src3'""")
def q_source_filter_fields(spark, sf_dir):
    """Each source has its text in a column of its own (French in ``body``), and a predicate of the user's."""
    d = source_docs(spark, sf_dir)
    french = F.col("source") == "fr"
    d = d.withColumn("body", F.when(french, F.col("text"))).withColumn("text", F.when(french, F.lit("x" * 500)).otherwise(F.col("text")))
    spec = spec_df(spark).withColumn("text_col", F.when(french, F.lit("body")).otherwise(F.lit("text")))
    r = filters.source_filter(d, spec, scores(spark, sf_dir), extra=F.col("shard") != "src3", text_cols=("text", "body"))
    return r.select("doc_id", "source", F.md5("text").alias("text_md5"))


INTERLEAVE_SQL = f"""{FILTERED_SQL},
counts AS (SELECT source, count(*) AS n_docs FROM filtered GROUP BY source),
live AS (
  SELECT s.source, s.weight, s.spec_idx, c.n_docs,
         sum(s.weight) OVER (ORDER BY s.spec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS w_hi,
         sum(s.weight) OVER ()::DOUBLE AS w_tot,
         min(s.spec_idx) OVER () AS first_idx
  FROM spec s JOIN counts c ON s.source = c.source),
draws AS (SELECT unnest(range(0, (SELECT 2 * count(*) FROM filtered))) AS d),
u AS (SELECT d, ('0x' || substr(md5(concat_ws('|', {SEED}, d)), 1, 8))::BIGINT / 4294967296.0 AS uw FROM draws),
picked AS (
  SELECT u.d, l.source, l.n_docs FROM u JOIN live l
  ON u.uw * l.w_tot <= l.w_hi AND (u.uw * l.w_tot > l.w_hi - l.weight OR l.spec_idx = l.first_idx)),
ranked AS (
  SELECT d, source, n_docs, row_number() OVER (PARTITION BY source ORDER BY d) - 1 AS k FROM picked),
ranked2 AS (SELECT d, source, k, k // n_docs AS epoch, k % n_docs AS pos FROM ranked),
maxep AS (SELECT source, unnest(range(0, me + 1)) AS epoch FROM (SELECT source, max(epoch) AS me FROM ranked2 GROUP BY source)),
perm AS (
  SELECT f.*, m.epoch,
         row_number() OVER (PARTITION BY f.source, m.epoch
                            ORDER BY md5(concat_ws('|', {SEED}, f.source, m.epoch, f.doc_id)), f.doc_id) - 1 AS pos
  FROM filtered f JOIN maxep m ON f.source = m.source),
mixed AS (
  SELECT r.d, r.source, r.epoch, r.pos, r.k, p.doc_id, p.shard, p.n_chars
  FROM ranked2 r JOIN perm p ON r.source = p.source AND r.epoch = p.epoch AND r.pos = p.pos)"""


@query("weighted_interleave", oracle=f"""WITH {INTERLEAVE_SQL}
SELECT d, source, epoch, pos, k, doc_id, n_chars FROM mixed""")
def q_weighted_interleave(spark, sf_dir):
    _, mixed = interleaved(spark, sf_dir)
    return mixed.select("d", "source", "epoch", "pos", "k", "doc_id", "n_chars")


MIX_REALIZED_SQL = f"""WITH {INTERLEAVE_SQL},
per AS (SELECT source, count(*) AS n_draws, count(DISTINCT doc_id) AS n_unique_docs,
               sum(n_chars)::BIGINT AS n_chars, max(epoch) + 1 AS n_epochs FROM mixed GROUP BY source)
SELECT p.source, p.n_draws, p.n_unique_docs, p.n_chars, p.n_epochs,
       round(p.n_draws / l.n_docs, 6) AS epochs_used,
       round(p.n_draws / sum(p.n_draws) OVER (), 6) AS share,
       round(l.weight / l.w_tot, 6) AS target_share
FROM per p JOIN live l ON p.source = l.source"""


def flagship(spark, sf_dir):
    docs, mixed = interleaved(spark, sf_dir)
    return mix.mix_realized(mixed, spec_df(spark), docs)


query("mix_realized", oracle=MIX_REALIZED_SQL)(flagship)


@query("epoch_repeat", oracle=f"""
SELECT source AS shard, epoch, doc_id,
       row_number() OVER (PARTITION BY source, epoch
                          ORDER BY md5(concat_ws('|', {SEED}, source, epoch, doc_id)), doc_id) - 1 AS pos
FROM documents, (SELECT unnest(range(0, 3)) AS epoch)""")
def q_epoch_repeat(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("shard"), "doc_id")
    return mix.epoch_repeat(docs, 3, SEED, "doc_id", by=["shard"]).select("shard", "epoch", "doc_id", "pos")


@query("seeded_shuffle", oracle=f"""
SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, doc_id)), doc_id) - 1 AS shuffle_idx
FROM documents""")
def q_seeded_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mix.seeded_shuffle(docs, SEED, ["doc_id"])


# Chat tasks for mixtures: conversations split by language of the first user
# turn is not available, so tasks are conversation parity classes; the
# second task is given twice (oversampling), as in the reference's recipe.
def _conv_tasks(spark, sf_dir):
    from ..functions.ranking import dense_index
    conv = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    even = dense_index(conv.filter(F.col("conv_id") % 2 == 0), ["conv_id"], out="local_idx")
    odd = dense_index(conv.filter(F.col("conv_id") % 2 == 1), ["conv_id"], out="local_idx")
    return [even, odd, odd]


TASKS_SQL = """conv AS (SELECT DISTINCT conv_id FROM conversations),
t0 AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS local_idx, 0 AS task_idx FROM conv WHERE conv_id % 2 = 0),
t1 AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS local_idx, 1 AS task_idx FROM conv WHERE conv_id % 2 = 1),
t2 AS (SELECT conv_id, local_idx, 2 AS task_idx FROM t1),
allt AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""


@query("task_mixture", oracle=f"""WITH {TASKS_SQL}
SELECT task_idx, local_idx, conv_id,
       row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, task_idx, local_idx)), task_idx, local_idx) - 1 AS idx
FROM allt""")
def q_task_mixture(spark, sf_dir):
    return mix.task_mixture(_conv_tasks(spark, sf_dir), SEED).select("task_idx", "local_idx", "conv_id", "idx")


@query("task_sequence", oracle=f"""WITH {TASKS_SQL},
lens AS (SELECT task_idx, count(*) AS n FROM allt GROUP BY task_idx),
offs AS (SELECT task_idx, coalesce(sum(n) OVER (ORDER BY task_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lens)
SELECT a.task_idx, a.local_idx, a.conv_id, o.off + a.local_idx AS idx FROM allt a JOIN offs o USING (task_idx)""")
def q_task_sequence(spark, sf_dir):
    return mix.task_sequence(_conv_tasks(spark, sf_dir)).select("task_idx", "local_idx", "conv_id", "idx")


@query("mixture_index_lookup", oracle=f"""WITH {TASKS_SQL},
mixed AS (SELECT task_idx, local_idx, conv_id,
       row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, task_idx, local_idx)), task_idx, local_idx) - 1 AS idx
       FROM allt)
SELECT m.idx, m.task_idx, c.turn, c.role, length(c.text) AS n_chars
FROM mixed m JOIN conversations c ON m.conv_id = c.conv_id""")
def q_mixture_index_lookup(spark, sf_dir):
    """index -> (task, local index) -> rows: an equi join of the mixture map with the turns."""
    m = mix.task_mixture(_conv_tasks(spark, sf_dir), SEED)
    conv = table(spark, sf_dir, "conversations")
    return m.join(conv, "conv_id").select("idx", "task_idx", "turn", "role",
                                          F.length("text").alias("n_chars"))


@query("slice_view", oracle=f"""
SELECT doc_id, (idx - 3) // 4 AS view_idx FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, doc_id)), doc_id) - 1 AS idx FROM documents)
WHERE idx >= 3 AND idx < (SELECT count(*) - 5 FROM documents) AND (idx - 3) % 4 = 0""")
def q_slice_view(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    shuffled = mix.seeded_shuffle(docs, SEED, ["doc_id"], out="idx")
    return mix.slice_view(shuffled, start=3, stop=n - 5, step=4).select("doc_id", "view_idx")


@query("val_head", oracle=f"""
SELECT doc_id, CASE WHEN idx < 50 THEN 'val' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', {SEED}, doc_id)), doc_id) - 1 AS idx FROM documents)""")
def q_val_head(spark, sf_dir):
    docs = mix.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), SEED, ["doc_id"], out="idx")
    train, val = mix.val_head(docs, n=50, disjoint=True)
    return train.select("doc_id", F.lit("train").alias("split")).unionByName(
        val.select("doc_id", F.lit("val").alias("split")))


@query("limit_per_task", oracle="""
SELECT item_id, task FROM (
  SELECT item_id, item_id % 3 AS task, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS rn
  FROM benchmark) WHERE rn <= 5""")
def q_limit_per_task(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("task"))
    return mix.limit_per_task(b, 5, "task", ["item_id"]).select("item_id", "task")


@query("doc_cap", oracle="""
SELECT doc_id, left(text, 10000) AS text, greatest(length(text) - 10000, 0) AS n_cut FROM documents""")
def q_doc_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", doc_cap("text").alias("text"), F.greatest(F.length("text") - DOC_CAP, F.lit(0)).cast("long").alias("n_cut"))


GERMAN = "äöüßÄÖÜ"


@query("lang_letter_ratio", oracle=f"""
SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) = 0 THEN 0.0
  ELSE length(regexp_replace(text, '[^{GERMAN}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) END, 9) AS ratio
FROM documents""")
def q_lang_letter_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(lang_letter_ratio("text", GERMAN), 9).alias("ratio"))
