"""Streams with state against their batch results, over several micro-batches and restarts."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from textmill.operators.kernels import CropPacker
from textmill.plans import streams
from textmill.session import scratch_path
from textmill.streaming import jobs, packing

START = datetime(2026, 1, 1)


def model(docs, cap, buffer, batch, keep_tail=False):
    """Rows of a lane's documents, in order."""
    packer = CropPacker(cap, buffer, batch, keep_tail)
    placed = []
    for d in docs:
        if d:
            placed += packer.add(len(d), d)
    placed += packer.end()
    rows = {}
    for item, row, _, take in placed:
        rows.setdefault(row, []).extend(item[:take])
    return rows


@pytest.mark.parametrize("keep_tail", [False, True])
def test_stream_pack_equals_batch(spark, keep_tail):
    rng = random.Random(8)
    docs = [(k % 3, f"{k:04d}", START + timedelta(seconds=k), [k] * rng.choice([0, 1, 5, 17, 40])) for k in range(200)]
    src, out, ck = (scratch_path(spark, n) for n in ("pack-src", "pack-out", "pack-ck"))
    schema = "lane int, key string, time timestamp, tokens array<int>"

    def arrive(rows):
        rows = rng.sample(rows, len(rows))  # rows of a file come in any order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        packing.stream_pack(spark, src, out, ck, T=31, buffer=7, batch=4, keep_tail=keep_tail, idle_s=1000, late_s=0)

    arrive(docs[:60])
    arrive(docs[60:61])
    run()
    first = packing.packed_rows(spark, out).count()
    arrive(docs[61:])
    run()  # goes on from the checkpoint
    second = packing.packed_rows(spark, out).count()
    arrive([(None, "", START + timedelta(seconds=5000), None)])  # a heartbeat: all lanes are idle
    run()
    got = {(r["lane"], r["row"]): r["inputs"][:1] + r["targets"] for r in packing.packed_rows(spark, out).collect()}
    assert 0 < first < second < len(got)
    want = {(lane, row): tokens for lane in range(3) for row, tokens in model([d[3] for d in docs if d[0] == lane], 32, 7, 4, keep_tail).items()}
    assert got == want


class _State:
    """A list or value state that counts how often it was read."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(list(self.rows)) if isinstance(self.rows, list) else self.rows

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = row

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.held, self.place, self.timers = _State(), _State(), []

    def getListState(self, *_):
        return self.held

    def getValueState(self, *_):
        return self.place

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_pack_lanes_add_to_the_state_without_reading_it():
    """While a lane can't fill its buffer, a micro-batch costs what arrives, not what is held."""
    rng = random.Random(4)
    docs = [[k] * rng.choice([1, 5, 17, 40]) for k in range(90)]
    lanes, handle = packing.PackLanes(32, 50, 4, True, 1000), _Handle()
    lanes.init(handle)
    got = {}
    for k in range(0, 90, 9):
        part = pd.DataFrame({"time": pd.Timestamp(START), "key": [f"{i:04d}" for i in range(k, k + 9)], "tokens": [np.array(d, np.int32) for d in docs[k:k + 9]]})
        for out in lanes.handleInputRows((0,), iter([part]), handle):
            got.update(zip(out["row"], out["tokens"].map(list)))
        if k < 45:
            assert handle.held.reads == 0 and not got
        assert len(handle.timers) == 1
    for out in lanes.handleExpiredTimer((0,), handle, None):
        got.update(zip(out["row"], out["tokens"].map(list)))
    assert got == model(docs, 32, 50, 4, True)


def test_replayed_in_as_many_parts_at_any_size(spark):
    """Parts are in order, and each has the files that one micro-batch takes."""
    for n, each in ((40, 1), (1000, 9)):
        src = scratch_path(spark, "replayed")
        d = spark.range(n).repartition(3)
        assert streams.replayed(d, d["id"], src, rows_per_file=30) == each
        rows = spark.read.parquet(src).select("id", "_metadata.file_path", "_metadata.file_modification_time").collect()
        files = {}
        for i, path, at in rows:
            files.setdefault((at, path), []).append(i)
        order = [ids for _, ids in sorted(files.items())]
        assert len(order) == streams.ARRIVALS * each
        parts = [sum(order[k:k + each], []) for k in range(0, len(order), each)]
        assert sorted(sum(parts, [])) == list(range(n))
        assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))


EVENTS = "run string, event_id long, ts_us long, value double"


def ema(rows, beta):
    """Of rows (event_id, ts_us, value) of a run: {event_id: (step, value)}."""
    out, s = {}, 0.0
    for step, (i, _, x) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        s = beta * s + (1 - beta) * x
        out[i] = (step, s / (1 - beta ** (step + 1)))
    return out


def test_stream_ema_with_late_rows(spark):
    """Rows of a file are shuffled, one run has most rows, one is new later; late ones are listed and change nothing."""
    rng = random.Random(2)
    rows = [(("hot" if k % 3 else rng.choice(["a", "b", None])) if k < 250 or k % 2 else "new", k, 1000 * (k // 2), rng.random()) for k in range(400)]
    late = [("hot", 1000, 5, 1.0), ("hot", 1001, 1000 * 99, 2.0), (None, 1002, 0, 3.0)]
    src, out, ck = (scratch_path(spark, n) for n in ("ema-src", "ema-out", "ema-ck"))

    def arrive(part):
        spark.createDataFrame(rng.sample(part, len(part)), EVENTS).coalesce(1).write.mode("append").parquet(src)

    arrive(rows[:100])
    arrive(rows[100:220])
    jobs.stream_ema(spark, src, out, ck, beta=0.8)
    arrive(rows[220:] + late)
    jobs.stream_ema(spark, src, out, ck, beta=0.8)  # goes on from the checkpoint
    got = {r["event_id"]: r for r in jobs.streamed_ema(spark, out).collect()}
    assert sorted(r["event_id"] for r in jobs.streamed_ema(spark, out, "late").collect()) == [1000, 1001, 1002]
    assert len(got) == len(rows)
    for run in ("hot", "a", "b", None, "new"):
        for i, (step, value) in ema([r[1:] for r in rows if r[0] == run], 0.8).items():
            assert (got[i]["run"], got[i]["step"]) == (run, step)
            assert abs(got[i]["ema"] - value) < 1e-9


def test_stream_ema_of_nothing(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("ema-src", "ema-out", "ema-ck"))
    spark.createDataFrame([], EVENTS).write.parquet(src)
    jobs.stream_ema(spark, src, out, ck)
    assert jobs.streamed_ema(spark, out).count() == jobs.streamed_ema(spark, out, "late").count() == 0
