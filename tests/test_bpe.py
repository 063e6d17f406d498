"""BPE against the public encoder of the same vocabulary, and against merging one pair after the other."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions.text import SPLIT_PATTERN
from textmill.operators import bpe
from textmill.plans.tokens import EDGE_TEXTS, VOCABULARY, VOCABULARY_MULTI


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}


def naive(piece, ranks):
    parts = [piece[k:k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


def test_pieces_merge_as_one_by_one():
    rng = random.Random(1)
    tokens = [bytes([b]) for b in b"abc"]
    tokens += sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(30)}, key=lambda t: (len(t), t))
    for _ in range(300):
        order = tokens[:3] + rng.sample(tokens[3:], len(tokens) - 3)
        ranks = {t: k for k, t in enumerate(order)}
        piece = bytes(rng.choices(b"abc", k=rng.randint(1, 25)))
        if piece not in ranks:
            assert bpe.encode_piece(piece, ranks) == naive(piece, ranks)


def test_long_piece():
    assert len(bpe.encode_piece(b"ab" * 50_000, {b"a": 0, b"b": 1, b"ab": 2})) == 50_000


@pytest.mark.parametrize("path", [VOCABULARY, VOCABULARY_MULTI])
def test_ids_are_those_of_the_public_encoder(spark, path):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + EDGE_TEXTS + ["", None, "日本語 ñandú 🙂🙂", "x" * 5000]
    enc = bpe.BPEEncoder.from_file(spark, path)
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    d = d.withColumn("ids", enc.encode(F.col("text"))).withColumn("back", enc.decode(F.col("ids"))).withColumn("n", enc.count(F.col("text")))
    for r in d.collect():
        text = texts[r["i"]]
        assert r["text"] == r["back"] == text
        assert r["ids"] == (None if text is None else own.encode_ordinary(text))
        assert r["n"] == (None if text is None else len(r["ids"]))


def test_nested_arrays(spark):
    enc = bpe.BPEEncoder.from_file(spark, VOCABULARY)
    rows = [(1, ["one two", "", "three"]), (2, []), (3, None), (4, ["four", None])]
    d = spark.createDataFrame(rows, "k int, texts array<string>").coalesce(1)
    one = lambda t: enc.encode(F.lit(t))
    want = spark.range(1).select(one("one two").alias("a"), one("three").alias("b"), one("four").alias("c")).first()
    got = {r["k"]: r["ids"] for r in d.select("k", enc.encode_array(F.col("texts")).alias("ids")).collect()}
    assert got == {1: [want["a"], [], want["b"]], 2: [], 3: None, 4: [want["c"], None]}


def test_vocabulary_must_be_dense(spark):
    with pytest.raises(ValueError):
        bpe.BPEEncoder(spark, {b"a": 0, b"b": 2})


def greedy(words, n_merges):
    """Merges of a plain loop over chunks and their counts, and the chunks' ids."""
    seqs, merges = {w: list(w.encode()) for w in words}, []
    while len(merges) < n_merges:
        n = {}
        for w, ids in seqs.items():
            for pair in zip(ids, ids[1:]):
                n[pair] = n.get(pair, 0) + words[w]
        if not n:
            break
        (left, right), count = min(n.items(), key=lambda x: (-x[1], x[0]))
        new = 256 + len(merges)
        merges.append((len(merges), left, right, new, count))
        for w, ids in seqs.items():
            out = []
            for i in ids:
                if out and out[-1] == left and i == right:
                    out[-1] = new
                else:
                    out.append(i)
            seqs[w] = out
    return merges, seqs


def some_words(rng, many):
    return {"".join(rng.choices(rng.choice(["ab", "abc", "aé", "abcdefgh"]), k=rng.randint(1, 30))): rng.choice([1, 1, 2, 40]) for _ in range(many)}


def test_training_goes_on_to_the_whole_vocabulary(spark, tmp_path):
    """it stopped after 24 merges; small texts are merged until no pair is left, and 32,503 merges are learnt of larger ones."""
    from textmill.operators import tokenize as tok
    from textmill.plans import tokens

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(12)] + [None, "", "x"]
    spark.createDataFrame([(None if k == 3 else k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = dict(map(tuple, tok.pretoken_counts(tokens.table(spark, str(tmp_path), "documents")).collect()))
    want, _ = greedy(words, tokens.BPE_VOCAB)
    got = sorted(tuple(m) for m in tokens.q_bpe_train(spark, str(tmp_path)).collect())
    assert tokens.BPE_VOCAB == 32_768 and len(want) > 300 and got == want
    table = tokens.q_token_bytes_table(spark, str(tmp_path)).collect()
    assert len(table) == 256 + len(want) + 9 and max(r["n_bytes_true"] for r in table) == max(len(w.encode()) for w in words)


@pytest.mark.parametrize("most_pairs,most_ids", [(1 << 16, 1 << 20), (7, 1 << 20), (40, 60), (3, 1)])
def test_rounds_find_the_merges_of_a_job_for_each(spark, most_pairs, most_ids):
    """With few pairs and ids a round, and pairs that overlap themselves and tie."""
    words = some_words(random.Random(most_pairs), 60)
    n_merges = 60 if most_pairs < 40 else 100_000
    want, _ = greedy(words, n_merges)
    d = spark.createDataFrame(list(words.items()), "chunk string, n long")
    vocab, merges = bpe.bpe_train(d, 256 + 9 + n_merges, checkpoint_every=20, most_pairs=most_pairs, most_ids=most_ids)
    assert sorted(tuple(m) for m in merges.collect()) == want
    assert vocab.count() == 256 + 9 + len(want)


def test_training_without_chunks(spark):
    vocab, merges = bpe.bpe_train(spark.createDataFrame([("x", 3), (None, 1)], "chunk string, n long"), 32_768)
    assert vocab.count() == 256 + 9 and merges.count() == 0


@pytest.mark.parametrize("steps", [0, 1, 32])
def test_merges_of_a_batch_are_made_in_their_order(monkeypatch, steps):
    """By steps over the whole batch, and by a heap for sequences of more merges."""
    import numpy as np

    monkeypatch.setattr(bpe, "STEPS", steps)
    rng = random.Random(steps)
    for _ in range(30):
        words = some_words(rng, 20)
        merges, seqs = greedy(words, rng.choice([3, 1000]))
        flat = np.array([b for w in words for b in w.encode()], np.int32)
        row = np.repeat(np.arange(len(words)), [len(w.encode()) for w in words])
        flat, row = bpe._Merges([m[1:4] for m in merges]).apply(flat, row)
        assert flat.tolist() == [i for w in words for i in seqs[w]]
        assert row.tolist() == [k for k, w in enumerate(words) for _ in seqs[w]]
