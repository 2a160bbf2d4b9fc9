"""The last state of each path of an event stream, in Spark's own state store.

A `transformWithState` keyed by path keeps (removed, seq) for each path: rows of a batch touch only the states of their own paths, the
store (RocksDB) writes only what changed, and the query's checkpoint makes a restart go on where the last batch ended. A removed path
can be forgotten by a timer. The states are read back by the state data source, also while no query runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATES = "path string, removed boolean, seq long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastState(StatefulProcessor):
    """Keeps the event with the highest seq of each path, and gives it where it is new. With `forget_ms`, a path that was last removed
    is forgotten so long after its event came in; an event that comes back meanwhile keeps it."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "removed boolean, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        removed, seq = max(((r.removed, r.seq) for r in rows), key=lambda r: r[1])
        before = self.state.get() if self.state.exists() else None
        if before is not None and before[1] >= seq:
            return
        self.state.update((removed, seq))
        if self.forget_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if removed:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield Row(path=key[0], removed=removed, seq=seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class KeyedStates:
    """The states of a stream of events (path, removed, seq) in one folder that the cluster shares. Rows without a path or seq say
    nothing; of a path's events with one seq any counts."""

    def __init__(self, spark: SparkSession, folder: str, forget_ms: int | None = None):
        self.spark, self.folder, self.forget_ms = spark, folder.rstrip("/"), forget_ms

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/states"

    def updates(self, events: DataFrame) -> DataFrame:
        """The stream of states that events change."""
        named = events.where("path is not null and seq is not null").select("path", F.coalesce("removed", F.lit(False)).alias("removed"), F.col("seq").cast("long").alias("seq"))
        mode = "ProcessingTime" if self.forget_ms is not None else "None"
        return named.groupBy("path").transformWithState(LastState(self.forget_ms), STATES, "Update", mode)

    def start(self, events: DataFrame, once: bool = True) -> StreamingQuery:
        """Follow events from where the last query on this folder stopped; `once`: up to what is there now. A query with timers has
        no end of its own, as it waits for them, so it can't run once."""
        if once and self.forget_ms is not None:
            raise ValueError("a query that forgets paths runs until it is stopped: once=False")
        before = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the provider that it starts with
        try:
            writer = self.updates(events).writeStream.outputMode("update").option("checkpointLocation", self.checkpoint).format("noop")
            return (writer.trigger(availableNow=True) if once else writer).start()
        finally:
            if before is None:
                self.spark.conf.unset(_PROVIDER)
            else:
                self.spark.conf.set(_PROVIDER, before)

    def _kept(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/commits")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(at) and any(s.getPath().getName().isdigit() for s in files.listStatus(at))

    def table(self) -> DataFrame:
        """(path, removed, seq) after the last batch that ended."""
        if not self._kept():
            return self.spark.createDataFrame([], STATES)
        found = self.spark.read.format("statestore").option("stateVarName", "last").load(self.checkpoint)
        return found.select("key.path", "value.removed", "value.seq")
