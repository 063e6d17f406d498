"""Line deduplication by a distributed suffix array over line ids (DataFrame functions only).

Every document is a sequence of line ids; a line is deleted if a run of at least
``min_lines`` consecutive lines that covers it also starts earlier, in a document with a
smaller id or further up.  Runs of one line count by default, but a blank line (whitespace
only) is no run of its own: it goes with the line before or after it that isn't blank, where
the two also stand together earlier, so that paragraphs keep their gaps.

1. Lines are hashed (two 64-bit hashes) and counted; only lines that occur more than once can
   be part of a repeated run.  The others stay as ids that nothing equals.
2. Prefix doubling: ranks of suffixes by their first 1, 2, 4, ... lines.  A round pairs each
   suffix's rank with that of the suffix ``width`` lines further on (an equi-join on unique
   keys), range-sorts the distinct pairs, and takes the place in the sorted order as the new
   rank.  It ends when a round splits no rank, after about log2 of the longest repeat.
3. Neighbours in suffix order get their longest common prefix by descending through the ranks
   of all widths.  Intervals whose prefixes have ``min_lines`` lines or more hold the
   occurrences of a run; all but the first, by one aggregation per interval, are later copies.  Pairs with a blank line are the
   intervals of two lines or more.
4. Later copies that overlap or touch within a document merge into maximal deleted runs.

A line that a third of all documents share is a hot join key on one side only (AQE splits
it), and a single row in every aggregated table.

Defined cases: null or empty text is one empty line; runs don't cross documents; overlapping
occurrences in one document count; rows that repeat an id come one after the other, rows
that repeat id and text are copies of the first; a null id comes before all others; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_rows, cut, dense_sorted_index, sorted_index, table

MIN_LINES = 1
CHUNK = 100_000


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, i, x, pos, left, mark, h1, h2): a row per line; u numbers the documents, x hashes their text.

    left: lines from pos to the end, so that of all lines at pos 0; mark: 1 for a line that isn't blank, and 2 more if just one of it and the next is blank.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("x"), F.monotonically_increasing_id().alias("u"), F.split(text, "\n", -1).alias("l"))
    rows = rows.withColumn("full", F.transform("l", lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    following = F.slice("full", F.lit(2), F.size("full"))
    lines = rows.select("u", "i", "x", F.size("l").alias("size"), F.posexplode(F.arrays_zip("l", "full", following.alias("after"))).alias("pos", "at"))
    line, full, after = F.col("at.l"), F.col("at.full"), F.col("at.after")
    mark = F.when(full, 1).otherwise(0) + F.when(full != after, 2).otherwise(0)
    return cut(lines.select("u", "i", "x", "pos", (F.col("size") - F.col("pos")).alias("left"), mark.cast("byte").alias("mark"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")), "lines")


def active_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """(u, pos, i, mark, left, r) of the lines that occur more than once, and how many ranks there are."""
    ids = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ids = sorted_index(ids, F.col("h1"), F.col("h2"), name="line-ids")
    many = lines.join(ids, ["h1", "h2"])
    return cut(many.select("u", "pos", "i", "mark", "left", F.col("rank").alias("r")), "ranks-1"), ids.count()


def _ahead(ranks: DataFrame, width: int) -> DataFrame:
    return ranks.select(F.col("u").alias("au"), (F.col("pos") - width).alias("ap"), F.col("r").alias("ar"))


def doubled(ranks: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Ranks by twice ``width`` lines, and how many there are."""
    both = ranks.join(_ahead(ranks, width), (F.col("u") == F.col("au")) & (F.col("pos") == F.col("ap")), "left")
    # after the end of a document nothing follows; a line that occurs once is equal to itself only
    kind = F.when(F.col("left") <= width, 0).when(F.col("ar").isNull(), 1).otherwise(2)
    both = both.select("u", "pos", "i", "mark", "left", "r", kind.alias("k"), F.when(kind == 1, F.col("u")).when(kind == 2, F.col("ar")).otherwise(0).alias("a"),
                       F.when(kind == 1, F.col("pos")).otherwise(0).alias("b"))
    both = cut(both, "doubled")  # read by the distinct pairs, their sampled bounds and the join
    pairs = sorted_index(both.select("r", "k", "a", "b").distinct(), *[F.col(c) for c in ("r", "k", "a", "b")], name="pairs")
    new = both.join(pairs, ["r", "k", "a", "b"])
    return cut(new.select("u", "pos", "i", "mark", "left", F.col("rank").alias("r")), "ranks"), pairs.count()


def suffix_ranks(lines: DataFrame) -> dict[int, DataFrame]:
    """{width: ranks by that many lines}; the widest orders all suffixes, and equal ranks of it are equal to the end."""
    ranks, distinct = active_ranks(lines)
    levels, width = {1: ranks}, 1
    while distinct:
        ranks, now = doubled(ranks, width)
        width *= 2
        levels[width] = ranks
        if now == distinct:
            break
        distinct = now
    return levels


def common_prefixes(levels: dict[int, DataFrame]) -> DataFrame:
    """(rank, u, pos, i, mark, lcp) in suffix order; lcp: lines shared with the suffix before."""
    last = levels[max(levels)]
    order = dense_sorted_index(last, F.col("r"), F.col("i").asc_nulls_first(), F.col("u"), F.col("pos"), name="suffixes")
    before = order.select((F.col("rank") + 1).alias("rank"), F.col("u").alias("u0"), F.col("pos").alias("p0"), F.col("r").alias("r0"))
    state = order.select("rank", "u", "pos", "i", "mark", "left", "r").join(before, "rank", "left")
    state = state.withColumn("lcp", F.when(F.col("r") == F.col("r0"), F.col("left")).otherwise(0))
    # the widest two levels have the same classes, those of suffixes that are equal to the end
    for width in sorted(levels, reverse=True)[2:]:
        mine = levels[width].select(F.col("u").alias("mu"), F.col("pos").alias("mp"), F.col("r").alias("mr"))
        other = levels[width].select(F.col("u").alias("ou"), F.col("pos").alias("op"), F.col("r").alias("orr"))
        state = state.join(mine, (F.col("u") == F.col("mu")) & (F.col("pos") + F.col("lcp") == F.col("mp")), "left")
        state = state.join(other, (F.col("u0") == F.col("ou")) & (F.col("p0") + F.col("lcp") == F.col("op")), "left")
        more = F.least(F.lit(width), F.col("left") - F.col("lcp"))
        state = state.withColumn("lcp", F.when(F.col("mr") == F.col("orr"), F.col("lcp") + more).otherwise(F.col("lcp")))
        state = cut(state.select("rank", "u", "pos", "i", "mark", "left", "u0", "p0", "lcp"), "lcp")
    return state


def intervals(prefixes: DataFrame, min_lines: int) -> DataFrame:
    """(u, pos, i, mark, interval): maximal stretches of suffix order that share ``min_lines`` lines."""
    opens = prefixes.withColumn("o", (F.col("lcp") < min_lines).cast("long")).withColumn("c", F.floor(F.col("rank") / CHUNK))
    within = F.sum("o").over(Window.partitionBy("c").orderBy("rank"))
    totals = opens.groupBy("c").agg(F.sum("o").alias("t"))  # a row for every CHUNK suffixes
    start = F.coalesce(F.sum("t").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return opens.withColumn("w", within).join(totals.select("c", start.alias("s")), "c").select("u", "pos", "i", "mark", (F.col("w") + F.col("s")).alias("interval"))


def _not_first(members: DataFrame, length: int) -> DataFrame:
    """(u, pos, end) of the members of an interval but its first, which are runs of ``length`` lines."""
    at = F.struct(F.col("i").isNotNull().alias("has"), F.col("i"), F.col("u"), F.col("pos"))
    members = cut(members.select("u", "pos", "interval", at.alias("at")), "intervals")
    first = members.groupBy("interval").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = members.join(first, "interval").filter(F.col("at") != F.col("first"))
    return later.select("u", "pos", (F.col("pos") + length).alias("end"))


def later_copies(lines: DataFrame, min_lines: int) -> DataFrame:
    """(u, pos, end): the shortest runs that count and also start earlier."""
    levels = suffix_ranks(lines)
    if len(levels) == 1:
        return levels[1].select("u", "pos", (F.col("pos") + 1).alias("end")).limit(0)
    prefixes = common_prefixes(levels)
    if min_lines > 1:
        return _not_first(intervals(prefixes, min_lines), min_lines)
    # the members of an interval have the same first lines, so they have the same marks
    single = _not_first(intervals(prefixes, 1).filter(F.col("mark").bitwiseAND(F.lit(1)) > 0), 1)
    return single.unionByName(_not_first(intervals(prefixes, 2).filter(F.col("mark").bitwiseAND(F.lit(2)) > 0), 2))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """One row per document: u, i, x, n_lines, n_removed, runs (array of start, end)."""
    lines = line_table(docs, id_col, text_col)
    starts = later_copies(lines, min_lines)
    own = Window.partitionBy("u").orderBy("pos", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("pos") > F.coalesce(reached, F.lit(-1))).cast("int")
    runs = starts.withColumn("new", new).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("u", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))  # of one document
    sizes = lines.filter("pos = 0").select("u", "i", "x", F.col("left").cast("long").alias("n_lines"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = sizes.join(runs, "u", "left").withColumn("runs", F.coalesce("runs", none))
    return whole.withColumn("n_removed", F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the lines of later copies deleted; a document of deleted lines only has an empty text."""
    found = cut(repeated_runs(docs, id_col, text_col, min_lines), "line-runs")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1]))
    found = found.select(F.col("i").alias("of"), "x", "runs", nth("i", "x", "u").alias("k"))
    row, text = F.col("row"), F.col("row")[text_col]
    mine = as_rows(docs).select("row", row[id_col].alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    mine = mine.withColumn("n", nth("i", "h", F.lit(1)))
    hit = mine.join(found, F.col("i").eqNullSafe(F.col("of")) & (F.col("h") == F.col("x")) & (F.col("n") == F.col("k")))
    gone = lambda p: F.exists("runs", lambda r: (p >= r["start"]) & (p < r["end"]))
    kept: Column = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, p: ~gone(p)), "\n")
    return hit.select(*[(F.when(F.size("runs") > 0, kept).otherwise(text) if c == text_col else row[c]).alias(c) for c in docs.columns])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_runs(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    return got.select(F.col("i").alias("doc_id"), "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), spans.alias("removed_runs"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM l),
w AS (SELECT *, lead(line) OVER d AS line2, lead(filled) OVER d AS filled2 FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, pos + 1 AS e, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM w WHERE filled
      UNION ALL
      SELECT doc_id, pos, pos + 2 AS e, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS nth FROM w WHERE filled <> filled2),
later AS (SELECT doc_id, pos, e, CASE WHEN pos <= max(e) OVER (PARTITION BY doc_id ORDER BY pos, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 THEN 0 ELSE 1 END AS new FROM f WHERE nth > 1),
runs AS (SELECT doc_id, min(pos) AS s, max(e) AS e
         FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos, e) AS run FROM later) GROUP BY doc_id, run),
per AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_runs, string_agg(s || '-' || e, ',' ORDER BY s) AS removed_runs FROM runs GROUP BY doc_id)
SELECT n.doc_id, n.n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(removed_runs, '') AS removed_runs
FROM (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) n LEFT JOIN per USING (doc_id)
"""
