"""A batcher as a stateful stream: documents wait until a batch is full or the oldest has waited long enough."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = StructType([StructField("id", StringType()), StructField("document", StringType())])
BATCHES = "lane int, ids array<string>, documents array<string>, reason string"


class _Waiting(StatefulProcessor):
    """What waits in one lane, in the order of arrival. A timer is set when the first document of a batch arrives."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _HELD)

    def _timers(self) -> list[int]:
        return list(self.handle.listTimers())

    def _batch(self, key, rows: list[tuple], reason: str) -> Row:
        return Row(lane=key[0], ids=[r[0] for r in rows], documents=[r[1] for r in rows], reason=reason)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        had = len(held)
        held += [(r["id"], r["document"]) for r in rows]
        while len(held) >= self.size:
            yield self._batch(key, held[: self.size], "full")
            held, had = held[self.size :], 0
        if held:
            self.waiting.put(held)
        else:
            self.waiting.clear()
        if not had:  # another document is the oldest now
            for t in self._timers():
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            held = [(r[0], r[1]) for r in self.waiting.get()]
            self.waiting.clear()
            yield self._batch(key, held, "due")

    def close(self) -> None:
        pass


def batches(documents: DataFrame, size: int, wait_ms: int, lanes: int = 8) -> DataFrame:
    """(lane, ids, documents, reason) of a stream (id, document): batches of ``size``, or of what waits once the oldest
    has waited for ``wait_ms``.

    Documents are dealt to ``lanes`` by id, so that no task holds them all; a lane holds fewer than ``size`` between two
    micro-batches. The state survives a restart from the checkpoint. Needs the RocksDB state store.
    """
    if size < 1 or wait_ms < 1 or lanes < 1:
        raise ValueError("a batch, its wait and the lanes are positive")
    documents.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")
    rows = documents.select(F.col("id").cast("string").alias("id"), F.col("document").cast("string").alias("document")).withColumn("lane", lane)
    return rows.groupBy("lane").transformWithState(_Waiting(size, wait_ms), BATCHES, "Append", "ProcessingTime")
