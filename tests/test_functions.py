"""Ranking helpers, md5 draws and BPE against plain Python."""

import random

import pandas as pd
from pyspark.sql import functions as F

from textmill.functions.ranking import dense_index, running_sum
from textmill.operators import bpe


def test_running_sum_matches_pandas(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot"]), rng.randint(0, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    got = running_sum(df, "v", ["k"], by=["g"], out="cs").toPandas().sort_values("k")
    pdf = pd.DataFrame(rows, columns=["k", "g", "v"]).sort_values("k")
    pdf["cs"] = pdf.groupby("g")["v"].cumsum()
    assert got["cs"].tolist() == pdf["cs"].tolist()
    idx = dense_index(df, ["k"], out="i").toPandas().sort_values("k")
    assert idx["i"].tolist() == list(range(3000))


def test_result_independent_of_partitions(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    a = running_sum(df, "id", ["id"], by=["g"], n_buckets=2).toPandas().sort_values("id")
    b = running_sum(df.repartition(7), "id", ["id"], by=["g"], n_buckets=13).toPandas().sort_values("id")
    assert a["cum"].tolist() == b["cum"].tolist()


def test_null_string_and_repeated_keys(spark):
    """No row is lost, and the result is the same for any number of buckets."""
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else rng.choice(["a", "same", "same", "zz", "é"]), k, None if rng.random() < 0.25 else rng.choice("xy"), rng.randint(0, 9))
            for k in range(1000)]
    df = spark.createDataFrame(rows, "s string, k long, g string, v long")
    first = None
    for n in (1, 4, 50):
        got = running_sum(df, "v", ["s", "k"], by=["g"], n_buckets=n, previous={"p": "k"}).toPandas()
        assert len(got) == 1000
        now = sorted(got[["k", "cum", "p"]].astype("Int64").itertuples(index=False, name=None), key=repr)
        first = first or now
        assert now == first
    idx = dense_index(df, ["s", "k"], n_buckets=7).toPandas().sort_values("idx")
    assert idx["idx"].tolist() == list(range(1000))
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert idx["k"].tolist() == [r[1] for r in want]


def test_repeated_first_key_is_spread(spark):
    from textmill.functions.ranking import BKT, with_bucket
    df = spark.range(10_000).withColumn("s", F.lit("hot"))
    sizes = [r["count"] for r in with_bucket(df, ["s", "id"], 10).groupBy(BKT).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3000


def test_ema_equals_sequential(spark):
    from textmill.operators.runs import ema_debiased
    rng = random.Random(6)
    xs = [rng.uniform(-1, 5) for _ in range(3000)]
    df = spark.createDataFrame([(None if k % 2 else "run", k // 2, xs[k]) for k in range(3000)], "run string, step long, x double")
    for beta in (0.2, 0.9, 0.999):
        got = ema_debiased(df, "run", "step", "x", beta).toPandas()
        assert len(got) == 3000
        for name, part in got.groupby("run", dropna=False):
            s, seq = 0.0, []
            for k, x in enumerate(part.sort_values("step")["x"]):
                s = beta * s + (1 - beta) * x
                seq.append(s / (1 - beta ** (k + 1)))
            assert max(abs(a - b) for a, b in zip(seq, part.sort_values("step")["ema"])) < 1e-9


def test_repack_has_no_statistics(spark, tmp_path):
    import pyarrow.parquet as pq
    from textmill.sources import shards
    d = spark.createDataFrame([(0, k, f"text {k}") for k in range(50)], "shard_id int, row_in_shard long, text string")
    for repack in (False, True):
        shards.write_text_shards(d, f"{tmp_path}/{repack}", repack=repack)
        file = next((tmp_path / str(repack)).rglob("*.parquet"))
        stats = pq.read_metadata(file).row_group(0).column(0).statistics
        assert (stats is None or not stats.has_min_max) == repack


def test_missing_paths_and_large_specs(spark, tmp_path):
    import pytest
    from textmill.operators import filters
    from textmill.sources import shards
    with pytest.warns(UserWarning):
        good, rejects = shards.read_chat_jsonl(spark, f"{tmp_path}/nothing")
    assert good.count() == rejects.count() == 0
    spec = spark.range(12_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(0).alias("min_len"), (F.col("id") % 2 == 0).alias("use_score"))
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 12_000).alias("source"), F.lit("t").alias("text"))
    scores = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(3.0).alias("score"))
    assert filters.source_filter(docs, spec, scores).count() == 12_000 + 6_000


def test_requests_without_scored_tokens_stay(spark):
    from textmill.operators import evalm
    t = spark.createDataFrame([(1, 0, 1, -2.0, False), (1, 1, 2, -1.0, True)], "req long, pos long, n_cont long, lp double, is_argmax boolean")
    one = evalm.score_continuation(t, 1, ["req"]).first()
    assert (one["loglik"], one["is_greedy"], one["n_scored"]) == (0.0, True, 0)
    assert evalm.rolling_loglik(t.filter("pos = 0"), 4, ["req"]).first()["loglik"] == 0.0


def test_bpe_merge_and_roundtrip(spark):
    texts = ["aaa abab", "the the theme", "hello hello", "x"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    from textmill.operators import tokenize as tok
    vocab, merges = bpe.bpe_train(tok.pretoken_counts(d), 256 + 9 + 5, checkpoint_every=2)
    m = merges.orderBy("rank").collect()
    assert len(m) == 5 and m[0]["token_id"] == 256
    enc = bpe.BPEEncoder.trained(vocab, merges)
    r = d.select("text", enc.decode(enc.encode(F.col("text"))).alias("back")).collect()
    assert all(x["text"] == x["back"] for x in r)
    assert bpe.encode_piece(b"aaa", {b"a": 0, b"aa": 1}) == [1, 0]


def test_uniform_places_equal_the_columns(spark):
    """Draws of a batch are those of the columns, for any key, and null ones."""
    from textmill.functions.hashing import uniform, uniform_places
    keys, counts = [7, None, 0, -(2**63), 2**63 - 1, 12], [3, 12, 0, 101, 1100, 20_000]
    rows = [(k, p) for k, n in zip(keys, counts, strict=True) for p in range(n)]
    want = [r[0] for r in spark.createDataFrame(rows, "k long, p int").coalesce(1).select(uniform(42, "k", "p")).collect()]
    assert uniform_places(42, keys, counts).tolist() == want
    assert len(uniform_places(42, [], [])) == 0


def test_token_nll_is_drawn_in_batches(spark, tmp_path, monkeypatch):
    """Each token's nats are the draw of its document and place; no md5 column is left in the plan."""
    from textmill.functions.hashing import uniform
    from textmill.plans import evaluation
    rng = random.Random(9)
    rows = [(None if k % 9 == 0 else k // 2, None if k % 7 == 0 else "é" * rng.randrange(40), None if k % 5 == 0 else "en") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(evaluation, "TOKENS", 100)
    got = evaluation.doc_token_nll(spark, str(tmp_path))
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = evaluation.doc_tokens(spark, str(tmp_path)).withColumn("nats", uniform(evaluation.SEED, "doc_id", "pos") * 10.0)
    key = lambda r: repr(tuple(r))
    assert got.columns == ["doc_id", "lang", "pos", "tok", "nats"]
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*got.columns).collect()))
