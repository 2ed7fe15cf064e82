"""Stateful streams in event-time order, whatever the order of arrival.

Each key keeps the rows that are not yet behind the watermark in a list state.  When
the watermark has passed them, by new data or by an event-time timer, they are handed
on in order.  So a result is that of one sorted pass for all rows up to the watermark
delay late, across micro-batches too; rows later than that are dropped by the
watermark.  State per key is what the operator keeps and the rows of one delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@contextmanager
def rocksdb(spark: SparkSession):
    """State in RocksDB for the queries started inside."""
    key, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ours)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


class InOrder(StatefulProcessor):
    """``held``: the columns of a row, ``ts_us`` (microseconds) among them;
    ``order``: how rows are sorted.  ``due`` gets a key's rows behind the watermark in
    order (none when only a timer ran out)."""

    held: T.StructType
    order: tuple = ("ts_us",)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        """States of the operator itself."""

    def due(self, key, ready: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.held)
        self.setup(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release(key, pd.concat([*rows])[self.held.names], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def wake(self, ms: int) -> None:
        """Call ``due`` again once the watermark has passed ``ms``."""
        self.handle.registerTimer(int(ms))

    def _release(self, key, new: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        kept = list(self.pending.get()) if self.pending.exists() else []
        held = pd.DataFrame(kept, columns=self.held.names)
        rows = held if new is None else new if held.empty else pd.concat([held, new])
        behind = rows["ts_us"].astype("int64") // 1000 < watermark
        rest = rows[~behind]
        if len(rest):
            kinds = [int if f.dataType == T.LongType() else bool if f.dataType == T.BooleanType() else float if f.dataType == T.DoubleType() else str
                     for f in self.held]
            self.pending.put([tuple(None if pd.isna(x) else kind(x) for kind, x in zip(kinds, r)) for r in rest.itertuples(index=False)])
            self.wake(rest["ts_us"].min() // 1000)
        elif kept:
            self.pending.clear()
        yield from self.due(key, rows[behind].sort_values(list(self.order), ignore_index=True), watermark)
