"""Suffix-array dedup against brute force, also with its bucket functions run in one process."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import suffixes
from test_corpus import SCHEMA, corpus, frame

from textmill.llm import suffix_dedup as S


def got_of(frame_):
    return {r["i"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.removals(frame_).collect()}


def test_removals(spark):
    rows = corpus(5, 60)
    assert got_of(frame(spark, rows)) == suffixes(rows)


def test_repeated_ids_and_nulls(spark):
    long = "".join(random.Random(1).choices("abcdef ", k=400))
    rows = [(5, long), (5, long), (5, "start " + long), (3, "other " + long[100:220]), (None, long), (None, long), (9, None), (9, "")]
    got = sorted((r["i"] or 0, r["n_bytes"], r["n_removed"]) for r in S.removals(frame(spark, rows)).collect())
    # rows of one id leave each other alone; those without id come last
    assert got == sorted([(5, 400, 120), (5, 400, 120), (5, 406, 120), (3, 126, 0), (0, 400, 400), (0, 400, 400), (9, 0, 0), (9, 0, 0)])


def test_empty(spark):
    assert S.removals(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 10**6])
def test_buckets_in_process(hot, monkeypatch):
    """Strings of very common anchors go by their own bytes; the result is the same."""
    monkeypatch.setattr(S, "HOT", hot)
    rows = [(i, t) for i, t in corpus(7, 50)]
    want = suffixes(rows)
    first = {}
    for i, t in sorted(rows):
        first.setdefault((t or "").encode(), i)
    bodies, reps = list(first), list(first.values())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.binary())], ["x", "text"])
    spread = pa.Table.from_batches(S._spread(4)(iter([batch])))
    met = [S._met(spread.filter(pa.compute.equal(spread["bucket"], b))) for b in sorted(set(spread["bucket"].to_pylist()))]
    lists = {}
    for table in met:
        for r in table.to_pylist():
            a, b = lists.setdefault(r["node"], ([], []))
            a.append(r["tokens"])
            b.append(r["hot"])
    near = [k for k in range(len(bodies)) if k in lists]
    batch = pa.RecordBatch.from_arrays([
        pa.array([reps[k] for k in near], pa.int64()), pa.array([0] * len(near), pa.int64()), pa.array([len(bodies[k]) for k in near], pa.int64()),
        pa.array([pa.compress(bodies[k], "zstd", asbytes=True) for k in near], pa.binary()), pa.array([lists[k][0] for k in near], pa.list_(pa.binary())),
        pa.array([lists[k][1] for k in near], pa.list_(pa.binary()))], ["i", "o", "size", "z", "tokens", "hot"])
    contexts = pa.Table.from_batches(S._contexts(5)(iter([batch])))
    spans = {}
    for b in sorted(set(contexts["bucket"].to_pylist())):
        for r in S._copies(contexts.filter(pa.compute.equal(contexts["bucket"], b))).to_pylist():
            spans.setdefault(r["rep"], []).append(r["spans"])
    for body, rep in first.items():
        have = S.merged(np.frombuffer(b"".join(spans[rep]), np.int32).reshape(-1, 2).astype(np.int64)) if rep in spans else np.zeros((0, 2), np.int64)
        assert (int((have[:, 1] - have[:, 0]).sum()), len(have)) == want[rep][1:3], rep


def test_previous_factor_and_ranks():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.arange(0, 350)
    strings = [data[s:s + 50].tobytes() for s in start]
    rank = S.ranks(data, start)
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert rank.tolist() == [order[s] for s in strings]
    rank, owner = rng.integers(0, 12, 200), rng.integers(0, 6, 200)
    want = [any(rank[j] == rank[k] and owner[j] < owner[k] for j in range(200)) for k in range(200)]
    assert S.previous_factor(rank, owner).tolist() == want
