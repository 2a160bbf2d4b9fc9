"""Change events as a stream: each micro-batch invalidates paths, and a scan that looks at them alone follows.

Events are (path, removed, is_directory). A file source can't see deletions, so they come as events too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbordex.functions import text

EVENTS = "path string, removed boolean, is_directory boolean"


def dirty_paths(events: DataFrame) -> list[str]:
    """The normalised paths of a batch of events, sorted, each once; one watcher's batch is small by nature."""
    return [r[0] for r in events.select(text.normalize_path(F.col("path")).alias("path")).where("path <> ''").distinct().orderBy("path").collect()]


def follow(events: DataFrame, rescan: Callable[[list[str]], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `rescan(paths)` for each micro-batch that names any path."""

    def batch(df: DataFrame, _: int) -> None:
        paths = dirty_paths(df)
        if paths:
            rescan(paths)

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Watcher:
    """Change events gathered from a stream until someone asks for them. They wait in a folder that the cluster shares, a table for
    each micro-batch; a drain writes down the last batch that it took and then removes the tables up to it. So neither a restart nor a
    lost executor loses an event, and what was drained once is not given again. Only the paths that a drain asks for reach the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.query, self.folder = spark, None, ""

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def start(self, events: DataFrame, folder: str, every: str = "1 second") -> None:
        """Gather `events` (EVENTS) in a folder that the cluster shares, looking for new ones at most once in `every`; a watcher that
        runs goes on, and one that starts anew on a folder goes on from where the last one stopped."""
        if self.query is not None and self.query.isActive:
            return
        self.folder = folder.rstrip("/")

        def batch(df: DataFrame, number: int) -> None:
            # a batch that runs again after it was drained has nothing new
            if number > self.taken():
                named = df.select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1)  # one watcher's batch is small by nature
                if not named.isEmpty():
                    named.write.mode("overwrite").parquet(f"{self.folder}/events/batch={number}")

        self.query = events.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=every).start()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def status(self) -> dict:
        """Whether it runs, whether a whole scan is needed instead, and the stream's error if it broke."""
        running = self.query is not None and self.query.isActive
        broken = self.query.exception() if self.query is not None and not running else None
        return {"running": running, "requires_full_rescan": not running, "last_error": str(broken).split("\n")[0] if broken else ""}

    def taken(self) -> int:
        """The last batch that a drain took, -1 if none: the name of an empty file."""
        path, files = self._files()
        at = path(f"{self.folder}/taken")
        return max((int(s.getPath().getName()) for s in files.listStatus(at)), default=-1) if files.exists(at) else -1

    def _waiting(self) -> list[int]:
        """The batches whose tables are whole and not taken."""
        if not self.folder:
            return []
        path, files = self._files()
        at, taken = path(f"{self.folder}/events"), self.taken()
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(n for name in names if (n := int(name.split("=")[1])) > taken and files.exists(path(f"{self.folder}/events/{name}/_SUCCESS")))

    def _events(self, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(*[f"{self.folder}/events/batch={n}" for n in batches])

    def dirty_paths(self) -> list[str]:
        """The paths that wait, sorted, each once."""
        batches = self._waiting()
        return dirty_paths(self._events(batches)) if batches else []

    def drain(self) -> list[str]:
        """The paths that wait; afterwards they no longer do."""
        batches = self._waiting()
        if not batches:
            return []
        paths = dirty_paths(self._events(batches))
        path, files = self._files()
        files.create(path(f"{self.folder}/taken/{batches[-1]}"), True).close()
        for n in batches:
            files.delete(path(f"{self.folder}/events/batch={n}"), True)
        for s in files.listStatus(path(f"{self.folder}/taken")):
            if int(s.getPath().getName()) < batches[-1]:
                files.delete(s.getPath(), False)
        return paths


def latest_state(events: DataFrame) -> DataFrame:
    """(path, removed): what the last event of each path says; for batches and for streams in complete mode."""
    return events.groupBy("path").agg(F.max_by("removed", F.struct("seq")).alias("removed"), F.max("seq").alias("seq"))
