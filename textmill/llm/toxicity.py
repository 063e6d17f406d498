"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

Features are sparse: the lower-cased words of a text and their prefixes of 4 to 7 characters,
each present or not.  From a bounded sample of labelled documents (``MAX_TOXIC`` and
``MAX_CLEAN`` rows, smallest crc32 of the id first) Spark counts in how many toxic and clean
documents each feature occurs; of those ``MIN_RATIO`` times commoner in toxic ones, the
``MAX_FEATURES`` with the highest likelihood ratio statistic G2 are kept.

Labels only say toxic or not, so severity grades are made for fitting: 0 for clean documents,
and for toxic ones 1, 2 or 3 as a third of them each has few, more or many of the kept
features.  The model is P(grade >= k) = sigmoid(w.x - b_k) with one weight vector for
all grades and ordered thresholds b_1 < b_2 < b_3, fitted by gradient descent on the exact
likelihood with an L2 penalty.  Every whole text is scored by the same features; the result
holds the probabilities, the expected severity (their sum, 0 to 3) and ``toxic``, which is
P(grade >= 1) >= 0.5.

Defined cases: null or empty text has no features and the score of such a text; labels that
repeat an id count once, toxic if any says so; labels without a document, or null, are
ignored; with no toxic or no clean labelled document nothing is toxic (severity 0); an empty
table gives an empty result; other columns are passed through by ``rejecting``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MAX_TOXIC = 4_000
MAX_CLEAN = 8_000
MAX_FEATURES = 500
MIN_G2 = 12.0
MIN_RATIO = 20.0
PREFIXES = (4, 5, 6, 7)
GRADES = 3
L2 = 1e-4
STEPS = 600
REJECT = 0.5
RESULT = "doc_id long, p1 double, p2 double, p3 double, expected_severity double, grade int, toxic boolean"
_WORDS = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words, as ``=word``, and prefixes of words."""
    words = set(_WORDS.findall((text or "").lower()))
    found = {w[:k] for w in words for k in PREFIXES if len(w) >= k}
    found.update("=" + w for w in words)
    return found


def _present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            for f in features(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
        yield pd.DataFrame([(f, c[1], c[0]) for f, c in counts.items()], columns=["f", "bad", "good"])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, text, toxic) of at most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents."""
    marked = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic")))
    marked = marked.select(F.col("doc_id").alias("l"), "toxic", F.crc32(F.col("doc_id").cast("string")).alias("draw"))
    pick = lambda t, n: marked.filter(F.col("toxic") == t).orderBy("draw", "l").limit(n)
    chosen = F.broadcast(pick(1, MAX_TOXIC).unionByName(pick(0, MAX_CLEAN)))  # bounded by the parameters
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))
    return cut(rows.join(chosen, F.col("i") == F.col("l")).select("i", "text", "toxic"), "toxicity-sample")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES,
                l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(y >= k) = sigmoid(x.w - b_k), by Adam on the likelihood.

    (row, col) list the present features.  Thresholds stay ordered, being a first value and
    positive steps from it.
    """
    n = len(grade)
    w, first, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(grades - 1)
    state = [np.zeros(n_features + grades), np.zeros(n_features + grades)]
    # both classes weigh the same, however rare toxic documents are in the sample
    weight = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum()))
    k = np.arange(1, grades + 1)
    for step in range(1, steps + 1):
        b = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weights=w[col], minlength=n)
        p = np.column_stack([np.ones(n), _sigmoid(score[:, None] - b[None, :]), np.zeros(n)])
        at = np.arange(n)
        hi, lo = p[at, grade], p[at, grade + 1]  # P(y >= grade), P(y >= grade + 1)
        like = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
        g_score = -weight * (slope_hi - slope_lo) / like
        g_b = np.array([(weight * ((grade == j) * slope_hi - (grade + 1 == j) * slope_lo) / like).sum() for j in k])
        g_gaps = np.exp(gaps) * np.cumsum(g_b[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(col, weights=g_score[row], minlength=n_features) + l2 * w, [g_b.sum()], g_gaps])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, first, gaps = w - move[:n_features], first - move[n_features:n_features + 1], gaps - move[n_features + 1:]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """({feature: weight}, thresholds) from the labelled sample."""
    sample = training_sample(docs, labels, id_col, text_col)
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad_n, good_n = sizes.get(1, 0), sizes.get(0, 0)
    never = {}, np.array([50.0 + k for k in range(GRADES)])
    if not bad_n or not good_n:
        return never
    counted = (sample.select("text", "toxic").mapInPandas(_present, "f string, bad long, good long")
               .groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    n, seen = bad_n + good_n, F.col("bad") + F.col("good")
    term = lambda x, of, by: F.when(x > 0, x * F.log(x * n / (of * by))).otherwise(0.0)
    g2 = 2 * (term(F.col("bad"), seen, bad_n) + term(F.col("good"), seen, good_n)
              + term(bad_n - F.col("bad"), n - seen, bad_n) + term(good_n - F.col("good"), n - seen, good_n))
    kept = (counted.filter(F.col("bad") * good_n >= MIN_RATIO * (F.col("good") + 0.5) * bad_n).withColumn("g2", g2).filter(F.col("g2") >= MIN_G2)
            .orderBy(F.desc("g2"), "f").limit(MAX_FEATURES).collect())
    index = {r["f"]: j for j, r in enumerate(kept)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"toxic": rows["toxic"], "own": [sorted(index[f] for f in features(t) if f in index) for t in rows["text"]]})

    own = sample.select("text", "toxic").mapInPandas(present, "toxic int, own array<int>").collect()  # bounded: sample x features
    size = np.array([len(r["own"]) for r in own])
    toxic = np.array([r["toxic"] for r in own])
    row = np.repeat(np.arange(len(own)), size)
    col = np.array([j for r in own for j in r["own"]], dtype=np.int64)
    cuts = np.quantile(size[toxic == 1], [j / GRADES for j in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, size, side="left"), 0)
    w, b = fit_ordinal(row, col, grade, len(index))
    return {f: float(w[j]) for f, j in index.items()}, b


def _scorer(weights: dict[str, float], bounds: np.ndarray):
    known = weights.keys()

    def probabilities(texts) -> np.ndarray:
        score = np.array([sum(weights[f] for f in sorted(features(t) & known)) for t in texts])
        return _sigmoid(score[:, None] - bounds[None, :])
    return probabilities


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: probabilities of the grades, expected severity, toxic."""
    probabilities = _scorer(*fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            p = probabilities(rows["t"])
            yield pd.DataFrame({"doc_id": rows["i"], "p1": p[:, 0], "p2": p[:, 1], "p3": p[:, 2], "expected_severity": p.sum(1),
                                "grade": (p >= 0.5).sum(1).astype("int32"), "toxic": p[:, 0] >= REJECT})
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(run, RESULT)


def rejecting(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, unchanged."""
    probabilities = _scorer(*fit(docs, labels, id_col, text_col))

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(probabilities(text)[:, 0] >= REJECT)

    return docs.filter(~toxic(F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
