"""Sharding and packing plans against plain models: keys of any kind, repeated and missing ones, any partitioning."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from naive import budget_boundaries, first_fit_decreasing, greedy_pad_rows
from test_kernels import naive_bestfit_crop, packed

from textmill.operators import kernels, pack

T = 30
CAP = T + 1


def rows_of(kind, seed=3, n=240):
    """(key, n_chars, tokens): tokens tell rows apart; lengths may be NULL or 0."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice([None, 0, 1, 2, rng.randrange(1, 20), rng.randrange(1, 60)])
        key = {"int": k, "string": f"doc-{k:04d}", "repeated": k // 3, "missing": None if k % 3 == 0 else k}[kind]
        out.append((key, size, [1000 + k] * (size or 0)))
    out += out[-3:] if kind in ("repeated", "missing") else []  # equal in every column
    return out


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, n_chars int, tokens array<int>")


def lane(key, lanes, seed=42):
    text = "|".join([str(seed), *([] if key is None else [str(key)])])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % lanes


def by_lane(spark, rows, kind, lanes):
    """Rows of each lane in the planned order: keys, NULLs first; hashes decide among equal keys, so they are asked for."""
    ordered = pack.lane_rows(frame(spark, rows, kind), "doc_id", "n_chars", lanes, 42).orderBy("lane", *pack.ORDER).collect()
    out = defaultdict(list)
    for r in ordered:
        assert r["lane"] == lane(r["key"], lanes)
        out[r["lane"]].append((r["key"], r["len"]))
    assert sorted(map(str, (x for v in out.values() for x in v))) == sorted(str((k, n or 0)) for k, n, _ in rows)
    return out


def lines(plan):
    return sorted(((r["lane"], r["key"], r["row"], r["offset"], r["take"]) for r in plan.collect()), key=str)


def modelled(ordered, model):
    out = []
    for at, items in ordered.items():
        keys, sizes = [k for k, _ in items], np.array([n for _, n in items], np.int64)
        out += [(at, keys[k], int(r), int(o), int(t)) for k, r, o, t in model(sizes)]
    return sorted(out, key=str)


def greedy_crop(sizes, keep):
    group, closed = budget_boundaries(sizes, CAP)
    out = []
    for g in sorted(set(group.tolist())):
        at = 0
        for k in np.flatnonzero(group == g):
            if g < closed or keep:
                out.append((k, g, at, min(int(sizes[k]), CAP - at)))
            at += int(sizes[k])
    return out


def greedy_pad(sizes):
    rows, offs = greedy_pad_rows(sizes, CAP)
    return list(zip(range(len(sizes)), rows, offs, np.minimum(sizes, CAP), strict=True))


def without_empty(model):
    def run(sizes):
        full = np.flatnonzero(sizes > 0)
        return [(full[k], r, o, t) for k, r, o, t in model(sizes[full])]
    return run


def ffd(sizes):
    rows, offs, take = first_fit_decreasing(sizes, CAP)
    return list(zip(range(len(sizes)), rows, offs, take, strict=True))


def crop(sizes):
    return [(k, r, o, t) for r, row in enumerate(naive_bestfit_crop(sizes.tolist(), CAP, 9, 4)) for k, o, t in row]


def pad(sizes):
    return [p[:4] for p in packed(kernels.PadPacker(CAP, 5), np.minimum(sizes, CAP))]


PLANS = {
    "greedy_crop": (lambda d, n: pack.plan_greedy_crop(d, T, "doc_id", "n_chars", n), lambda s: greedy_crop(s, False)),
    "greedy_crop_tail": (lambda d, n: pack.plan_greedy_crop(d, T, "doc_id", "n_chars", n, keep_tail=True), lambda s: greedy_crop(s, True)),
    "greedy_pad": (lambda d, n: pack.plan_greedy_pad(d, T, "doc_id", "n_chars", n), greedy_pad),
    "ffd": (lambda d, n: pack.plan_ffd(d, T, "doc_id", "n_chars", n), without_empty(ffd)),
    "bestfit_crop": (lambda d, n: pack.plan_bestfit_crop(d, T, "doc_id", "n_chars", n, buffer=9, batch=4), without_empty(crop)),
    "bestfit_pad": (lambda d, n: pack.plan_bestfit_pad(d, T, "doc_id", "n_chars", n, buffer=5), without_empty(pad)),
}


@pytest.mark.parametrize("kind", ["int", "string", "repeated", "missing"])
@pytest.mark.parametrize("name", PLANS)
def test_plan(spark, name, kind):
    plan, model = PLANS[name]
    rows = rows_of(kind)
    lanes = 1 if kind == "string" else 3  # also one global lane
    assert lines(plan(frame(spark, rows, kind), lanes)) == modelled(by_lane(spark, rows, kind, lanes), model)


@pytest.mark.parametrize("name", PLANS)
def test_empty(spark, name):
    assert lines(PLANS[name][0](frame(spark, [], "int"), 2)) == []


@pytest.mark.parametrize("name", ["greedy_crop", "greedy_pad", "ffd"])
def test_partitions_change_nothing(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(lines(PLANS[name][0](frame(spark, rows_of("missing"), "missing"), 2)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


@pytest.mark.parametrize("multiple,keep", [(1, 0.5), (1, None), (4, None), (4, 0.1)])
@pytest.mark.parametrize("kind", ["int", "repeated", "missing"])
def test_shards(spark, kind, multiple, keep):
    rows = rows_of(kind)
    got = pack.shard_by_budget(frame(spark, rows, kind), 100, "doc_id", "n_chars", 3, keep_tail=keep, multiple=multiple)
    assert got.columns == ["doc_id", "n_chars", "tokens", "lane", "shard"]
    want, sizes_of = [], defaultdict(int)
    for at, items in by_lane(spark, rows, kind, 3).items():
        sizes = np.array([n for _, n in items])
        group, closed = budget_boundaries(sizes, 100, multiple)
        tail = int(sizes[group == closed].sum())
        for (key, n), g in zip(items, group.tolist(), strict=True):
            if g < closed or (keep is not None and tail >= keep * 100):
                want.append((key, n, at, g))
                sizes_of[key, n] += 1
    found = got.collect()
    assert sorted(((r["doc_id"], r["n_chars"] or 0, r["lane"], r["shard"]) for r in found), key=str) == sorted(want, key=str)
    if keep == 0.5:  # content comes with its own row
        assert all(len(r["tokens"]) == (r["n_chars"] or 0) for r in found)


@pytest.mark.parametrize("kind", ["int", "repeated", "missing", "string"])
def test_packed_rows(spark, kind):
    """Rows hold what the plan says; masked targets are -1."""
    rows = [(k, n, t, [j % 2 for j in range(len(t))]) for k, n, t in rows_of(kind)]
    d = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, n_chars int, tokens array<int>, mask array<int>")
    plan = pack.plan_bestfit_pad(d, T, "doc_id", "n_chars", 2, buffer=5)
    planned = defaultdict(list)
    for r in plan.collect():
        planned[r["lane"], r["row"]].append((r["offset"], r["take"], r["key"], r["content_len"]))
    got = pack.assemble_rows(plan, d, T, "doc_id", "tokens", pad_id=7, mask="mask").collect()
    assert len(got) == len(planned)
    for r in got:
        parts = sorted(planned[r["lane"], r["row"]])
        content = sum(p[1] for p in parts)
        assert {p[3] for p in parts} == {content} == {r["content_len"]}
        row = [r["inputs"][0]]
        assert len(r["inputs"]) == len(r["targets"]) == T
        mask = [j % 2 for p in parts for j in range(p[1])] + [0] * (CAP - content)
        row = list(r["inputs"])
        assert row[content:] == [7] * (T - content)
        for at, take, _, _ in parts:
            assert len(set(row[at:min(at + take, T)])) <= 1  # one document
        for j, target in enumerate(r["targets"]):
            masked = mask[j + 1] == 0 or (content < CAP and j >= content - 1)
            assert (target == -1) == masked
            assert masked or j + 1 >= T or target == row[j + 1]


@pytest.mark.parametrize("kind", ["int", "repeated", "missing", "string"])
def test_chunk_flat(spark, kind):
    rows = rows_of(kind)
    got = pack.chunk_flat(frame(spark, rows, kind), T, "doc_id", "tokens", keep_tail=True).orderBy("row").collect()
    flat = [t for r in got for t in r["tokens"]]
    assert all(len(r["tokens"]) == CAP for r in got[:-1])
    assert sorted(flat) == sorted(t for _, _, ts in rows for t in ts)
    if kind in ("int", "string"):
        assert flat == [t for _, _, ts in sorted(rows) for t in ts]
