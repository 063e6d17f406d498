"""Quality classifier: a sparse rule ensemble compiled into column expressions.

1. Statistics of the whole text (shares of symbols, capitals, repeated words, ...) are column
   expressions; label columns, language, source and id are never among them.
2. A small random forest is grown on a bounded sample of labelled rows (``MAX_ROWS``, smallest
   crc32 of the id first) that excludes the held-out rows, those with
   crc32(id as text) mod 3 = 1.  Each path from a root to a node is a rule, the
   conjunction of its conditions.
3. A lasso logistic regression over the rules sets most weights to 0.
4. The rules left become one expression of conditions and weights, which scores all rows in
   whole-stage code without Python.

Defined cases: null or empty text has the statistics of the empty text (0 everywhere) and
is scored like any other; labels that repeat an id count once, with the larger value; null
labels and labels without a document are ignored; with labels of one class only, or
none, every score is that class's share (0.5 without labels); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, table

MAX_ROWS = 20_000
TREES = 24
DEPTH = 3
LASSO = 0.002
SEED = 7
Rule = tuple[tuple[str, str, float], ...]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _share(count: Column, of: Column) -> Column:
    return F.when(of > 0, count / of).otherwise(F.lit(0.0)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name; expressions over ``__t`` (text), ``__w`` (words) and ``__n`` (their number)."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    chars, n, w = F.length(text), F.col("__n"), F.col("__w")
    again = F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))),
                                       lambda a, b: a == b), lambda same: same))
    return {
        "words": n.cast("double"),
        "chars_per_word": _share(chars, n),
        "lines_per_word": _share(count(r"\n"), n),
        "capitals": _share(count(r"\p{Lu}"), chars),
        "digits": _share(count(r"[0-9]"), chars),
        "stops": _share(count(r"[.,;:?]"), n),
        "marks": _share(count(r"[^\p{L}\p{N}\s.,;:?'\"()-]"), chars),
        "bars": _share(count(r"[|!]"), n),
        "distinct_words": _share(F.size(F.array_distinct(w)), n),
        "words_again": _share(again, n),
    }


def with_statistics(rows: DataFrame, text: str = "__t") -> DataFrame:
    """Add ``__w``, ``__n`` and a column ``s_NAME`` for each statistic."""
    rows = rows.withColumn("__w", F.regexp_extract_all(F.col(text), F.lit(WORD), 0)).withColumn("__n", F.size("__w"))
    return rows.withColumns({f"s_{k}": v for k, v in statistics(F.col(text)).items()}).drop("__w", "__n")


def tree_rules(node, path: tuple = ()) -> list[Rule]:
    """All conjunctions from the root to a node below it: ((feature index, op, threshold), ...)."""
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split = node.split()
    out: list[Rule] = []
    for child, op in ((node.leftChild(), "<="), (node.rightChild(), ">")):
        mine = (*path, (split.featureIndex(), op, split.threshold()))
        out += [mine, *tree_rules(child, mine)]
    return out


def simplified(rule, names: list[str]) -> Rule:
    """One bound for each statistic and direction."""
    bound: dict[tuple[int, str], float] = {}
    for f, op, x in rule:
        old = bound.get((f, op), x)
        bound[f, op] = min(old, x) if op == "<=" else max(old, x)
    return tuple(sorted((names[f], op, x) for (f, op), x in bound.items()))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, x in rule:
        out = out & ((F.col(name) <= x) if op == "<=" else (F.col(name) > x))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]) from labelled rows that aren't held out."""
    marked = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg(F.max(F.when(F.col("quality") != 0, 1.0).otherwise(0.0)).alias("y")))
    marked = (marked.filter(~held_out(F.col("doc_id"))).withColumn("draw", F.crc32(F.col("doc_id").cast("string")))
              .orderBy("draw", "doc_id").limit(max_rows))
    chosen = F.broadcast(marked.select(F.col("doc_id").alias("__l"), "y"))  # bounded by the parameter
    rows = docs.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).join(chosen, F.col("__i") == F.col("__l"))
    sample = cut(with_statistics(rows).drop("__t"), "quality-sample")
    names = [c for c in sample.columns if c.startswith("s_")]
    n, ones = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or ones in (0, n):
        p = min(max((ones or 0) / n, 1e-3), 1 - 1e-3) if n else 0.5
        return math.log(p / (1 - p)), []
    # one order of rows, so that bagging is the same in every run
    train = sample.repartition(1).sortWithinPartitions("__i", *names).select("y", array_to_vector(F.array(*names)).alias("x")).cache()
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5,
                                    featureSubsetStrategy="sqrt", seed=SEED).fit(train)
    train.unpersist()
    found = {simplified(r, names) for t in forest.trees for r in tree_rules(t._java_obj.rootNode())}
    rules = sorted(found)
    if not rules:
        p = ones / n
        return math.log(p / (1 - p)), []
    hits = F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules])
    design = sample.repartition(1).sortWithinPartitions("__i", *names).select("y", array_to_vector(hits).alias("x")).cache()
    model = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=LASSO, maxIter=100).fit(design)
    design.unpersist()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score, 0 to 1, as an expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = compiled(*fit(docs, labels, id_col, text_col))
    rows = with_statistics(docs.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")))
    scored = rows.select(F.col("__i").alias("doc_id"), held_out(F.col("__i")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
