"""Repeated and NULL keys neither multiply nor lose rows; carries and fits on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions.ranking import last_known, running_sum
from textmill.operators import filters, mix, runs


def documents(spark, kind):
    rng = random.Random(5)
    rows = [(k if kind == "int" else f"k{k // 3}" if kind == "repeated" else (None if k % 4 == 0 else f"k{k}"), rng.choice(["a", "b"]), f"text {k} " * rng.randint(0, 4)) for k in range(40)]
    rows += rows[-2:] if kind != "int" else []
    return rows, spark.createDataFrame(rows, f"doc_id {'long' if kind == 'int' else 'string'}, source string, text string")


@pytest.mark.parametrize("kind", ["int", "repeated", "missing"])
def test_interleave_draws_each_row_once_an_epoch(spark, kind):
    rows, d = documents(spark, kind)
    spec = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("none", 5, 2)], "source string, weight int, spec_idx int")
    n = 3 * len(rows)
    got = mix.weighted_interleave(d, spec, n).collect()
    assert sorted(r["d"] for r in got) == list(range(n))
    for source in "ab":
        own = sorted((r["doc_id"] or "", r["text"]) if kind != "int" else (r["doc_id"], r["text"]) for r in got if r["source"] == source and r["epoch"] == 0)
        whole = sorted((k or "", t) if kind != "int" else (k, t) for k, s, t in rows if s == source)
        assert own == whole  # with so many draws the first epoch is complete


@pytest.mark.parametrize("kind", ["int", "repeated", "missing"])
def test_char_budget(spark, kind):
    rows, d = documents(spark, kind)
    got = filters.char_budget_sample(d, 10**9, 12, ["doc_id"]).collect()
    assert sorted(map(str, ((r["doc_id"], r["source"], r["text"]) for r in got))) == sorted(map(str, rows))
    total = sum(min(len(t), 12) for _, _, t in rows)
    some = filters.char_budget_sample(d, total // 2, 12, ["doc_id"]).collect()
    taken = sum(min(len(r["text"]), 12) for r in some)
    assert total // 2 < taken <= total // 2 + 12


def test_empty(spark):
    _, d = documents(spark, "int")
    spec = spark.createDataFrame([("a", 1, 0)], "source string, weight int, spec_idx int")
    assert mix.weighted_interleave(d.limit(0), spec, 5).count() == 0
    assert filters.char_budget_sample(d.limit(0), 5, 5, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n_buckets", [1, 13])
def test_last_known_and_sums(spark, n_buckets):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["x", None]), k, rng.choice([None, None, k])) for k in range(300)]
    d = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = {r["k"]: r for r in last_known(d, "v", ["k"], ["g"], n_buckets=n_buckets).collect()}
    sums = {r["k"]: r for r in running_sum(d, F.lit(1), ["k"], ["g"], also={"s": F.col("k")}, n_buckets=n_buckets).collect()}
    for g in ("hot", "x", None):
        known, n, s = None, 0, 0
        for _, k, v in [r for r in rows if r[0] == g]:
            known, n, s = (known if v is None else v), n + 1, s + k
            assert (got[k]["known"], sums[k]["cum"], sums[k]["s"]) == (known, n, s)


def test_interpolation(spark):
    rng = random.Random(3)
    knots = {g: sorted((x, rng.random()) for x in rng.sample(range(100), n)) for g, n in (("a", 9), ("hot", 60), ("one", 1))}
    points = [(g, x) for g in knots for x in [-5.0, 200.0, None, *[rng.uniform(0, 100) for _ in range(50)], *[float(x) for x, _ in knots[g]]]] + [("none", 1.0)]
    k = spark.createDataFrame([(g, float(x), y) for g, v in knots.items() for x, y in v] + [("a", None, 1.0)], "g string, x double, y double")
    got = runs.interp_column(spark.createDataFrame(points, "g string, at double"), k, ["g"], "at").collect()
    assert len(got) == len(points)
    for r in got:
        if r["at"] is None or r["g"] == "none":
            assert r["interp"] is None
        else:
            xs, ys = zip(*knots[r["g"]])
            assert abs(r["interp"] - np.interp(r["at"], xs, ys)) < 1e-12


def test_ridge_on_complete_rows(spark):
    rows = [(float(k), 2.0 * k + 1) for k in range(20)] + [(None, 100.0), (3.0, None), (float("nan"), 5.0)]
    d = spark.createDataFrame(rows, "x double, y double")
    got = {r["term"]: r["coef"] for r in runs.ridge(d, ["x"], "y", [0.0]).collect()}
    assert abs(got["intercept"] - 1) < 1e-9 and abs(got["x"] - 2) < 1e-9
    assert runs.ridge(d.limit(0), ["x"], "y", [0.0]).count() == 0
    assert runs.linreg(d.withColumn("g", F.lit(1)).filter("NOT isnan(x) OR x IS NULL"), ["g"], "x", "y").first()["n"] == 20


def test_source_filter_text_columns(spark):
    d = spark.createDataFrame([(1, "a", "long enough", None), (2, "a", "x", "long enough"), (3, "b", "x", "long enough"), (4, "b", "long enough", None), (5, "c", "long enough", "long enough"),
                               (None, "b", None, "no key here")], "doc_id long, source string, text string, body string")
    spec = spark.createDataFrame([("a", 5, False, "text"), ("b", 5, False, "body")], "source string, min_len int, use_score boolean, text_col string")
    got = filters.source_filter(d, spec, text_cols=("text", "body")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "no key here"), (1, "long enough"), (3, "long enough")]
    scored = spec.withColumn("use_score", F.col("source") == "b")
    scores = spark.createDataFrame([(3, 2.5), (1, 0.0)], "doc_id long, score double")
    assert [r["doc_id"] for r in filters.source_filter(d, scored, scores, text_cols=("text", "body")).orderBy("doc_id").collect()] == [1, 3]
    assert [r["doc_id"] for r in filters.source_filter(d, scored, scores, threshold=0.0, extra=F.col("doc_id") > 1, text_cols=("text", "body")).collect()] == [3]
