"""Best-fit packing of a stream: each lane's buffer is state that outlives micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.kernels import CropPacker
from .jobs import _run

HEARTBEAT = -1  # stands for a NULL lane
WAITING, BUFFERED, OPEN, ARRIVED = 0, 1, 2, 3  # what a kept document is: of an incomplete batch, of the buffer, of the open row, not packed yet
HELD = "kind int, tokens binary"  # 32-bit ids, as they lie in memory
PLACE = "row long, pos long, n_held long, timer long"
ROWS = "lane int, row long, tokens array<int>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class PackLanes(StatefulProcessor):
    """Packs the documents of a lane as ``CropPacker`` does, in the order of (time, key).

    A lane that has had no document for ``idle_ms`` of event time is flushed: its buffer is
    placed, and its incomplete last row is dropped or kept.  Row numbers go on after a flush.

    Documents that can't fill the buffer are added to the state, which stays unread; the packer
    takes them up, in the same order, once there are enough to place any.
    """

    def __init__(self, cap: int, buffer: int, batch: int, keep_tail: bool, idle_ms: int):
        self.cap, self.buffer, self.batch, self.keep_tail, self.idle_ms = cap, buffer, batch, keep_tail, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.place = handle.getValueState("place", PLACE)

    def _placed(self) -> tuple[int, int, int, int]:
        """Row and position, the number of documents that wait or are buffered, and the timer (0: none)."""
        return tuple(self.place.get()) if self.place.exists() else (0, 0, 0, 0)

    def _load(self) -> tuple[CropPacker, list]:
        """The packer, and what is complete of the documents that it hadn't seen."""
        packer = CropPacker(self.cap, self.buffer, self.batch, self.keep_tail)
        packer.row, packer.pos, _, _ = self._placed()
        at, placed = 0, []
        for kind, data in self.held.get() if self.held.exists() else ():
            tokens = np.frombuffer(data, np.int32)
            if kind == WAITING:
                packer.waiting.append((len(tokens), tokens))
            elif kind == BUFFERED:
                packer.index.add(len(tokens), tokens)
            elif kind == OPEN:
                packer.open.append((tokens, packer.row, at, len(tokens)))
                at += len(tokens)
            else:
                placed += packer.add(len(tokens), tokens)
        return packer, placed

    def _keep(self, packer: CropPacker, timer: int) -> None:
        held = [(WAITING, item.tobytes()) for _, item in packer.waiting] + [(BUFFERED, item.tobytes()) for _, item in packer.buffered()]
        n_held = len(held)
        held += [(OPEN, item[:take].tobytes()) for item, _, _, take in packer.open]
        self.place.update((packer.row, packer.pos, n_held, timer))
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    @staticmethod
    def _rows(lane: int, placed: list) -> pd.DataFrame:
        rows: dict[int, list[np.ndarray]] = {}
        for item, row, _, take in placed:
            rows.setdefault(row, []).append(item[:take])
        return pd.DataFrame({"lane": pd.Series([lane] * len(rows), dtype="int32"), "row": pd.Series(list(rows), dtype="int64"),
                             "tokens": pd.Series([np.concatenate(pieces) for pieces in rows.values()], dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if int(key[0]) == HEARTBEAT:
            return
        arrived = pd.concat(list(rows))  # of one lane in one micro-batch
        arrived = arrived.sort_values(["time", "key"], kind="stable")
        items = [np.array([int(t) for t in tokens] if tokens.dtype.kind != "i" else tokens, np.int32)
                 for tokens in arrived["tokens"] if tokens is not None and len(tokens)]
        row, pos, n_held, old = self._placed()
        if old:
            self.handle.deleteTimer(old)
        timer = max(int(arrived["time"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        if n_held + len(items) < self.buffer:  # nothing can be placed
            if items:
                self.held.appendList([(ARRIVED, item.tobytes()) for item in items])
            self.place.update((row, pos, n_held + len(items), timer))
            return
        packer, placed = self._load()
        for item in items:
            placed += packer.add(len(item), item)
        self._keep(packer, timer)
        yield self._rows(int(key[0]), placed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        packer, placed = self._load()
        placed += packer.end()
        if packer.pos:  # an incomplete row that isn't kept leaves its number free
            packer.pos, packer.open = 0, []
        self._keep(packer, 0)
        yield self._rows(int(key[0]), placed)

    def close(self) -> None:
        pass


def stream_pack(spark: SparkSession, src: str, out: str, checkpoint: str, T: int, buffer: int = 1000, batch: int = 128,
                keep_tail: bool = False, idle_s: int = 3600, late_s: int = 600, files_per_trigger: int = 1) -> StreamingQuery:
    """Pack documents into rows of T+1 tokens as files of (lane, key, time, tokens) arrive.

    Files come in the order of ``time``; a document ``late_s`` or more behind the newest one of
    the batches before is late and dropped by the watermark, which starts at the epoch.  Rows with a NULL lane are heartbeats: they belong to
    no lane, but move time on, so that idle lanes are flushed.  Lanes bound what one task sees.
    """
    schema = spark.read.parquet(src).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(src)
    lane = F.coalesce("lane", F.lit(HEARTBEAT)).cast("int")  # not filtered, which would happen before time moves on
    s = s.select(lane.alias("lane"), F.col("key").cast("string").alias("key"), "time", "tokens").withWatermark("time", f"{late_s} seconds")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # the only store with list state and timers
    try:
        rows = s.groupBy("lane").transformWithStateInPandas(
            PackLanes(T + 1, buffer, batch, keep_tail, idle_s * 1000), ROWS, "Append", "EventTime")
        q = (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out))
        _run(q)
    finally:
        spark.conf.set(PROVIDER, before)
    return q


def packed_rows(spark: SparkSession, out: str) -> DataFrame:
    """What ``stream_pack`` wrote: (lane, row, inputs, targets)."""
    n = F.size("tokens")
    return spark.read.schema(ROWS).parquet(out).select("lane", "row", F.slice("tokens", 1, n - 1).alias("inputs"), F.slice("tokens", 2, n - 1).alias("targets"))
