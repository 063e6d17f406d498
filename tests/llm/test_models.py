"""Quality and toxicity models, WARC round trips and the pipeline."""

import base64
import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import SCHEMA, corpus, frame

import corpus_pipeline
from textmill.llm import quality, toxicity, warc
from textmill.llm.common import cut, shared_path, table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_held_out(spark):
    got = quality.op1_quality(spark, SF)
    both = got.join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    assert (both["predicted"] == both["quality"]).mean() > 0.95
    good, bad = both[both["quality"] == 1]["score"].to_numpy(), both[both["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert got.count() == table(spark, SF, "documents").count()
    assert got.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert got.filter("held_out <> (crc32(string(doc_id)) % 3 = 1)").count() == 0


def test_quality_rules_compile(spark):
    """The compiled expression equals rules applied one by one."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    intercept, rules = quality.fit(docs, labels)
    assert rules
    stats = quality.with_statistics(docs.limit(50).select(F.col("doc_id"), F.col("text").alias("__t")))
    for r in stats.withColumn("score", quality.compiled(intercept, rules)).collect():
        holds = lambda rule, r=r: all((r[f] <= x) if op == "<=" else (r[f] > x) for f, op, x in rule)
        total = intercept + sum(w for rule, w in rules if holds(rule))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_odd_rows(spark):
    rows = [*corpus(), (None, "text without id"), (None, None)]
    labels = spark.createDataFrame([(i, k % 2, None) for k, (i, _) in enumerate(corpus())] + [(None, 1, 0), (10**6, 0, 0), (1, None, 1)], LABELS)
    got = quality.quality(frame(spark, rows), labels)
    assert got.count() == len(rows)
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i, _ in corpus()], LABELS)
    assert quality.quality(frame(spark, rows), one).filter("predicted <> 1").count() == 0
    assert quality.quality(frame(spark, rows), spark.createDataFrame([], LABELS)).filter("score <> 0.5").count() == 0
    assert quality.quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_toxicity_labelled(spark):
    both = toxicity.op10_toxicity(spark, SF).join(table(spark, SF, "labels").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    found, clean = both[both["label"] == 1]["toxic"], both[both["label"] == 0]["toxic"]
    assert found.mean() > 0.85
    assert clean.mean() < 0.02
    assert np.allclose(both["expected_severity"], both[["p1", "p2", "p3"]].sum(axis=1))
    assert ((both["p1"] >= both["p2"]) & (both["p2"] >= both["p3"])).all()


def test_toxicity_new_documents(spark):
    """Learned words are found in documents without labels, in short and in very long ones."""
    rows = [(k, f"plain words number{k % 7} and more {'vile ' if k % 4 == 0 else ''}{'nasty ' if k % 8 == 0 else ''}text") for k in range(200)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)] + [(0, 1, 0), (None, 1, 1), (999, 0, 1), (5, 1, None)], LABELS)
    new = [(1001, "so vile"), (1002, "fine words"), (1003, "word " * 20000 + "Vile!"), (1004, None), (1005, ""), (1005, "a vile one")]
    docs = frame(spark, rows + new)
    got = {(r["doc_id"], r["toxic"]) for r in toxicity.severity(docs, labels).filter("doc_id > 1000").collect()}
    assert {(1001, True), (1002, False), (1003, True), (1004, False), (1005, False), (1005, True)} == got
    kept = toxicity.rejecting(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id > 1000").select("doc_id").collect()) == [1002, 1004, 1005]
    for one in ([], [(k, 1, 0) for k in range(200)], [(k, 1, 1) for k in range(200)]):
        assert toxicity.rejecting(docs, spark.createDataFrame(one, LABELS)).count() == docs.count()
    assert toxicity.severity(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_quality_against_brute_force(spark):
    """Statistics, rules and scores of whole texts, recomputed in plain Python."""
    odd = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "a a a | ! é É ß Ǆ 東 𝒳 — ' \" ( ) 1 2, 3."), (-5, "long word " * 30000), (None, "no id\u00a0here\x85\x00")]
    docs = frame(spark, [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()] + odd)
    labels = table(spark, SF, "labels")
    intercept, rules = quality.fit(docs, labels)
    want = sorted((brute.rule_score(r["text"], intercept, rules) for r in docs.select("text").collect()))
    assert sorted(r["score"] for r in quality.quality(docs, labels).collect()) == pytest.approx(want)
    stats = quality.with_statistics(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))).collect()
    for r in stats:
        assert {k: r[k] for k in r.asDict() if k.startswith("s_")} == pytest.approx(brute.statistics(r["__t"]))


def test_toxicity_against_brute_force(spark):
    """The features kept, the grades, the model and the scores, recomputed in plain Python."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    limits = {1: toxicity.MAX_TOXIC, 0: toxicity.MAX_CLEAN}
    kept, _, sample = brute.severity_sample(rows, [(r["doc_id"], r["toxic"]) for r in labels.collect()], limits, toxicity.MAX_FEATURES, toxicity.MIN_G2, toxicity.MIN_RATIO)
    weights, bounds = toxicity.fit(docs, labels)
    assert set(weights) == set(kept)
    index = {f: j for j, f in enumerate(kept)}
    row = np.array([k for k, (fs, _) in enumerate(sample) for _ in fs])
    col = np.array([index[f] for fs, _ in sample for f in fs])
    w, b = toxicity.fit_ordinal(row, col, np.array([g for _, g in sample]), len(kept))
    assert bounds == pytest.approx(b, abs=1e-6)
    assert {f: weights[f] for f in kept} == pytest.approx({f: w[j] for f, j in index.items()}, abs=1e-6)
    texts = dict(rows)
    for r in toxicity.op10_toxicity(spark, SF).collect():
        score = sum(w[index[f]] for f in brute.toxic_words(texts[r["doc_id"]]) if f in index)
        p = 1 / (1 + np.exp(-(score - b)))
        assert (r["p1"], r["p2"], r["p3"]) == pytest.approx(tuple(p), abs=1e-5)
        assert r["expected_severity"] == pytest.approx(p.sum(), abs=1e-5)
        assert abs(p[0] - toxicity.REJECT) < 1e-5 or r["toxic"] == (p[0] >= toxicity.REJECT)


def test_ordinal_fit():
    """Shared weights and ordered thresholds are found again from drawn grades."""
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.4
    w, b = np.array([3.0, 2.0, 1.0, 0.0, -1.0, -2.0]), np.array([1.0, 2.5, 4.0])
    latent = x @ w + rng.logistic(size=4000)
    grade = (latent[:, None] >= b[None, :]).sum(1)
    row, col = np.nonzero(x)
    flat = np.ones(4000)
    assert flat.sum() == 4000
    got, bounds = toxicity.fit_ordinal(row, col, grade, 6, l2=0.0, steps=1500)
    assert (np.diff(bounds) > 0).all()
    assert np.argsort(got).tolist() == np.argsort(w).tolist()


def pages(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 3000
    rows = [(1, "http://a.example/x?y#z", "<a>"), (2, "http://a.example", "<a>"), (3, None, "<a>"), (4, "bad url \r\n x", ""), (5, "https://b.example/", None), (6, "u", long),
            (9, "u", "WARC/1.0\r\n\r\n\r\n"), (9, "u", "WARC/1.0\r\n\r\n\r\n"), (9, "v", "other"), (None, "n", "<a>"), (None, "n", "alone")]
    return rows, spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, rep string")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    path = shared_path(spark, "warc-test")
    warc.write_pages(df.repartition(3), path)
    records = cut(warc.read_records(spark, path), "records")
    assert records.count() == 3 * len(rows)
    assert records.select("record_id").distinct().count() == 3 * len(rows)
    got = warc.transactions(records).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    firsts = 0
    for r in got:
        page = r["metadata"]["fields"]["page-id"]
        if r["response"]["type"] == "response":
            firsts += 1
            body = r["response"]["payload"].decode()
            assert (int(page) if page else -1) == best[body]
            assert r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        else:
            assert r["original"]["payload_digest"] == r["response"]["stated_digest"]
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["capture_id"]
    assert firsts == len(best)
    empty = shared_path(spark, "warc-empty")
    warc.write_pages(df.limit(0), empty)
    assert warc.transactions(warc.read_records(spark, empty)).count() == 0


def test_warc_query(spark, tmp_path):
    rows, df = pages(spark)
    df.filter("page_id is not null").dropDuplicates(["page_id"]).write.parquet(f"{tmp_path}/pages.parquet")
    kept = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{tmp_path}/pages.parquet").collect()}
    for r in warc.op2_warc(spark, str(tmp_path)).collect():
        html = kept[r["page_id"]]
        first = max(i for i, h in kept.items() if h == html)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert tuple(r) == (r["page_id"], len(html.encode()), digest, "response" if r["page_id"] == first else "revisit", None if r["page_id"] == first else first)


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against brute force where it is exact."""
    from brute import contamination, exact, near
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == names
        after = sorted(r["doc_id"] for r in docs.collect())
        if name == "exact dedup":
            assert after == sorted(i for i, _, _, k, _ in exact(before) if k)
        if name == "n-gram join":
            assert after == sorted(i for i, (n, c) in near(before).items() if n == 0 or c == i)
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
            assert after == sorted(i for i, w in contamination(before, items).items() if not w[4])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.columns == [*names, "copy_no"]
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))


def test_pipeline_empty(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
