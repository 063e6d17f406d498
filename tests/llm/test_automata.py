"""Substring dedup by suffix automata: the automaton, matching statistics and whole results against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from textmill import llm
from textmill.llm import automata as A

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, d string, x int, i string"


def brute(rows, length=35):
    """(id, n_words, n_removed, kept_sha256) of (id, text), sorted."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("i", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["the", "Mill", "mill", "é", "a.", "\0"]) + str(rng.randrange(9)) for _ in range(n))
    passage, line, long = words(60), words(40), words(3000)
    rows = [(k, f"{words(rng.randrange(50))} {passage} {words(rng.randrange(50))}\n{line if k % 3 == 0 else ''}") for k in range(60)]
    rows += [(100, long), (101, long[:5000] + " x " + long[5000:]), (102, "ab " * 200), (103, words(34)), (104, f"{line}\t\t{line}"), (None, passage), (None, passage), (105, passage.replace(" ", "\n")),
             (106, " "), (107, ""), (108, None), (109, words(34) + " " + words(34)), (100, words(80)), (110, line), (110, line)]
    return rows


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = llm.QUERIES["op13_substring_dedup"](spark, SF)
    want = brute(docs)
    assert sum(w[2] for w in want)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_odd_rows(spark, monkeypatch, hot):
    """Contexts of hot anchors are dealt by window; the result is the same."""
    monkeypatch.setattr(A, "HOT", hot)
    monkeypatch.setattr(A, "SAMPLE", 64 if hot else 1)
    monkeypatch.setattr(A, "CONTEXTS", 50)
    monkeypatch.setattr(A, "PART", 40)
    rows = rows_of(hot)
    frame = spark.createDataFrame([(*r, "d", 1, "y") for r in rows], SCHEMA)
    assert got(A.repeats(frame)) == brute(rows)


def test_empty(spark):
    assert A.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(A.repeats(spark.createDataFrame([(1, None, "", 1, "")], SCHEMA))) == brute([(1, None)])


def test_edges(spark):
    same = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"a b {same} c"), (2, f"{same} d")]
    found = {r["i"]: r["edges"] for r in A.repeats(spark.createDataFrame([(*r, "", 1, "") for r in rows], SCHEMA)).collect()}
    assert found == {1: [2, 42], 2: [0, 40]}


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 6))]
        times = [rng.randrange(1, 3) for _ in texts]
        automaton = A.Automaton()
        for t, n in zip(texts, times, strict=True):
            automaton.add(t, n)
        link, length, source, symbol, target = automaton.repeated()
        ways = dict(zip((source * 4 + symbol).tolist(), target.tolist(), strict=True))
        seen = Counter()
        for t, n in zip(texts, times, strict=True):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    seen[tuple(t[a:b])] += n
        query = [rng.randrange(4) for _ in range(40)]
        want = [max((e - s for s in range(e) if seen[tuple(query[s:e])] > 1), default=0) for e in range(1, 41)]
        assert A.matching(ways, link.tolist(), length.tolist(), query, 4) == want
