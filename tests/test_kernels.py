"""Packing / shard kernels against naive models written from the operator descriptions."""

import random

import numpy as np
import pytest
from naive import budget_boundaries, first_fit_decreasing, greedy_pad_rows

from textmill.operators import kernels


def packed(packer, lengths):
    """All placements of documents that arrive one by one."""
    out = []
    for k, n in enumerate(lengths):
        out += packer.add(int(n), k)
    return out + packer.end()


def choose(pool, room):
    """(length, arrival, taken) of the document to place: the longest that fits, else the shortest, cut."""
    fitting = sorted((d for d in pool if d[0] <= room), key=lambda d: (-d[0], d[1]))
    if fitting:
        return (*fitting[0], fitting[0][0])
    shortest = min(pool)
    return (*shortest, room)


def refill(pool, queue, wanted, batch):
    """Batches move from the queue to the pool until it holds the wanted number."""
    while queue and len(pool) < wanted:
        pool.extend(queue[:batch])
        del queue[:batch]


def naive_bestfit_crop(lengths, cap, buffer, batch):
    """Full rows as lists of (document, offset, taken)."""
    queue = [(n, k) for k, n in enumerate(lengths)]
    pool: list = []
    rows: list = [[]]
    room = cap
    refill(pool, queue, buffer, batch)
    while pool:
        n, k, taken = choose(pool, room)
        pool.remove((n, k))
        rows[-1].append((k, cap - room, taken))
        room -= taken
        if not room:
            rows.append([])
            room = cap
        refill(pool, queue, buffer, batch)
    return rows[:-1]  # the last one is empty or incomplete


def test_bestfit_crop_matches_naive():
    rng = random.Random(0)
    for _ in range(20):
        lengths = [rng.randint(1, 300) for _ in range(rng.randint(50, 400))]
        cap, buffer, batch = rng.choice([64, 129, 257]), rng.randint(3, 40), rng.randint(1, 10)
        got = packed(kernels.CropPacker(cap, buffer, batch), lengths)
        want = [(kk, ri, p, tk) for ri, row in enumerate(naive_bestfit_crop(lengths, cap, buffer, batch))
                for kk, p, tk in row]
        assert got == want


def test_bestfit_pad_places_the_longest_that_fits():
    """Replayed from the result: each placement is the best of what the buffer holds then."""
    rng = random.Random(4)
    lengths, cap, buffer = [rng.randint(1, 100) for _ in range(300)], 101, 12
    k, r, o, _, _ = zip(*packed(kernels.PadPacker(cap, buffer), lengths))
    waiting, held = list(range(len(lengths))), []
    row, used = 0, 0
    for doc, at, offset in zip(k, r, o):
        held += waiting[:buffer - len(held)]
        waiting = waiting[buffer - len(held):] if len(held) < buffer else [d for d in waiting if d not in held]
        if at != row:
            assert all(lengths[d] > cap - used for d in held)  # nothing fitted any more
            row, used = at, 0
        assert offset == used
        best = max((d for d in held if lengths[d] <= cap - used), key=lambda d: (lengths[d], -d))
        assert doc == best
        held.remove(doc)
        used += lengths[doc]


def test_bestfit_pad_rows_are_full_or_padded():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    got = packed(kernels.PadPacker(101, 20), lengths)
    assert sorted(p[0] for p in got) == list(range(500))  # every conversation used exactly once
    for row in {p[1] for p in got}:
        used = sum(lengths[p[0]] for p in got if p[1] == row)
        assert {p[4] for p in got if p[1] == row} == {used} and used <= 101


def test_budget_boundaries():
    lengths = np.array([5, 5, 5, 20, 1, 1, 1, 9])
    gid, closed = budget_boundaries(lengths, 10)
    assert list(gid) == [0, 0, 1, 1, 2, 2, 2, 2] and closed == 3
    gid, closed = budget_boundaries(lengths, 10, multiple=4)
    assert list(gid) == [0, 0, 0, 0, 1, 1, 1, 1] and closed == 2


def test_ffd_conserves_and_fits():
    rng = random.Random(2)
    lengths = np.array([rng.randint(1, 150) for _ in range(300)])
    rows, offs, take = first_fit_decreasing(lengths, 128)
    assert (take == np.minimum(lengths, 128)).all()
    for row in set(rows.tolist()):
        m = rows == row
        assert take[m].sum() <= 128
        spans = sorted(zip(offs[m], take[m]))
        for (a, la), (b, _) in zip(spans, spans[1:]):
            assert a + la <= b


def test_greedy_pad_rows():
    rows, offs = greedy_pad_rows(np.array([4, 4, 4, 10, 2]), 10)
    assert list(rows) == [0, 0, 1, 2, 3] and list(offs) == [0, 4, 0, 0, 0]


def test_ffd_runs_place_as_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        cap = rng.choice([7, 16, 101])
        lengths = np.array([rng.randint(1, cap) for _ in range(rng.randint(1, 200))])
        rows, offs, _ = first_fit_decreasing(lengths, cap)
        histogram = {int(n): int((lengths == n).sum()) for n in set(lengths.tolist())}
        runs = kernels.first_fit_runs(histogram, cap)
        for n in histogram:
            own = [r for r in runs if r[0] == n]
            assert [r[1] for r in own] == list(range(1, len(own) + 1))
            for at, k in enumerate(np.flatnonzero(lengths == n)):
                _, _, first, each, row0, fill = [r for r in own if r[2] <= at][-1]
                assert (row0 + (at - first) // each, fill + (at - first) % each * n) == (rows[k], offs[k])


def test_bpe_rounds_on_repeated_pairs(spark):
    """Merges of batches against a plain loop, with pairs that overlap themselves and ties."""
    from textmill.operators import bpe

    rng = random.Random(12)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))): rng.randint(1, 9) for _ in range(120)}
    seqs, want = {w: list(w.encode()) for w in words}, []
    for r in range(12):
        n = {}
        for w, ids in seqs.items():
            for pair in zip(ids, ids[1:]):
                n[pair] = n.get(pair, 0) + words[w]
        (left, right), count = min(n.items(), key=lambda x: (-x[1], x[0]))
        want.append((r, left, right, 256 + r, count))
        for w, ids in seqs.items():
            out = []
            for i in ids:
                if out and out[-1] == left and i == right:
                    out[-1] = 256 + r
                else:
                    out.append(i)
            seqs[w] = out
    _, merges = bpe.bpe_train(spark.createDataFrame(list(words.items()), "chunk string, n long"), 256 + 9 + 12, checkpoint_every=5)
    assert sorted(tuple(m) for m in merges.collect()) == want
    assert bpe.pair_counts(spark.createDataFrame([([1, 1, 1, 1, 1], 2)], "seq array<int>, n long"), [(1, 1, 300)]).collect() != []


def test_bpe_batches_are_worked_on_in_slices():
    """What a batch needs beside its result is bounded: no slice has many more entries than asked for."""
    import pyarrow as pa

    from textmill.operators import bpe

    rows = [["ab", "b"], None, [], ["abab"] * 9, ["c", ""], ["ab"]]
    lists = pa.array(rows, pa.list_(pa.string()))
    cut = list(bpe._cut(lists, 4))
    assert [r for part in cut for r in part.to_pylist()] == rows and len(cut) == 3
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3}
    pieces = bpe._Pieces(ranks, longest=2)
    assert pieces.encode(lists).to_pylist() == [[3, 1], None, [], [3, 3] * 9, [2], [3]]
    assert "abab" not in pieces.known and pieces.encode(lists.slice(0, 0)).to_pylist() == []


def test_repetition_of_a_long_text_is_linear(spark):
    """The text is split once: one of 60,000 words took minutes when every n-gram split it again."""
    import time

    from textmill.operators import chat

    rng = random.Random(3)
    words = [str(rng.randrange(40)) for _ in range(60_000)]
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
    d = spark.createDataFrame([(1, " " + "\n ".join(words)), (2, "a b c"), (3, "a b a b a b"), (4, None)], "id int, t string")
    begun = time.time()
    got = {r["id"]: r["s"] for r in d.select("id", chat.repetition_share(d["t"]).alias("s")).collect()}
    assert time.time() - begun < 60
    assert got[1] == pytest.approx(1 - len(set(grams)) / len(grams)) and got[2] == 0.0 and got[3] == pytest.approx(1 - 2 / 3)


def test_isoflop_carry_reads_the_knots_near_the_optimum(spark):
    from textmill.operators import runs

    rng = random.Random(5)
    rows = [(g, float(rng.randrange(60)), rng.random(), rng.random()) for g in ("a", "b", "c", "d") for _ in range(300)]
    d = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "g string, x double, t double, r double")
    opt = spark.createDataFrame([("a", 30.5), ("b", -7.0), ("c", 99.0), ("d", 12.0), ("e", 1.0)], "g string, x_opt double")
    assert runs._near(d, opt, ["g"], "x").select("g", "x").distinct().count() <= 4 * 4
    got = {r["g"]: (r["t_opt"], r["r_opt"]) for r in runs.isoflop_carry(opt, d, ["g"], "x", ["t", "r"]).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and got["e"] == (None, None)
    for g, at in (("a", 30.5), ("b", -7.0), ("c", 99.0), ("d", 12.0)):
        xs = sorted({x for k, x, _, _ in rows if k == g})
        for i in (0, 1):
            ys = [np.mean([row[2 + i] for row in rows if row[0] == g and row[1] == x]) for x in xs]
            assert got[g][i] == pytest.approx(np.interp(at, xs, ys))


def test_shards_get_their_columns_after_rows_are_dealt(spark, tmp_path):
    from pyspark.sql import functions as F

    from textmill.operators import tokenize as tok
    from textmill.sources import shards

    d = spark.createDataFrame([(k % 3, k // 3, None if k == 4 else "x" * k) for k in range(60)], "shard_id int, row_in_shard long, text string")
    shards.write_text_shards(d, f"{tmp_path}/t", columns=[tok.ByteEncoder().encode(F.col("text")).alias("tokens")])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert set(back.columns) == {"shard_id", "row_in_shard", "tokens"}
    got = {(r["shard_id"], r["row_in_shard"]): r["tokens"] for r in back.collect()}
    assert got == {(k % 3, k // 3): None if k == 4 else [120] * k for k in range(60)}
    assert back.filter("_metadata.row_index <> row_in_shard").count() == 0
