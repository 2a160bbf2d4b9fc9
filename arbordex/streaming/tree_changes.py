"""What changes in a tree of files as a stream, deletions too: a data source whose offsets are snapshots of the tree.

`spark.readStream.format("tree_changes").option("root", ...).option("state", ...).load()` gives (path, removed, is_directory), one row for
each path that came, changed (size, time, identity or kind) or went between two snapshots.

The tree is dealt into units: folders with all below them, and single folders above these. A snapshot is numbered; the task that reads
a unit lists it, keeps the listing as a file of the snapshot and gives the differences from the unit's listing in the snapshot
before. A task that runs again, after a failure or a restart, finds its listing there and gives the same rows. The driver lists only the
single folders, to see units come. Both folders must be reachable as files by driver and executors. What can't be read stays
as it was in the last snapshot.

The first snapshot gives no rows, as nothing is known to have changed, but with the option `existing` all that is there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from arbordex.sources import listing

EVENTS = "path string, removed boolean, is_directory boolean"
_LISTED = pa.schema([("path", pa.string()), ("directory", pa.bool_()), ("mark", pa.string())])
_EVENTS = pa.schema([("path", pa.string()), ("removed", pa.bool_()), ("is_directory", pa.bool_())])
#: Rows of one batch to Spark.
ROWS = 10_000


@dataclass
class Unit(InputPartition):
    """A folder (deep: with all below it), the snapshots to compare, and the unit's listing in them."""

    folder: str
    deep: bool
    before: str
    after: str
    first: bool


def _local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def _write(path: str, write) -> None:
    """A whole file or none: written under another name and renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fresh = f"{path}.{uuid.uuid4().hex}"
    write(fresh)
    os.replace(fresh, path)


class TreeChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = _local(options["root"]), _local(options["state"])
        self.skip = tuple(s for s in options.get("skip", ",".join(listing.SKIPPED)).split(",") if s)
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.existing = options.get("existing", "false").lower() == "true"
        self.wanted = int(options.get("units", "64"))

    # offsets: numbers of snapshots, each given out once

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        at = f"{self.state}/issued"
        number = 1 + (int(open(at).read()) if os.path.exists(at) else 0)
        _write(at, lambda fresh: _text(fresh, str(number)))
        return {"snapshot": number}

    def commit(self, end: dict) -> None:
        """Snapshots before the last committed one are no longer compared with."""
        if not os.path.isdir(self.state):
            return
        for name in os.listdir(self.state):
            if name.startswith("s") and name[1:].isdigit() and int(name[1:]) < end["snapshot"]:
                folder = f"{self.state}/{name}"
                for f in os.listdir(folder):
                    os.remove(f"{folder}/{f}")
                os.rmdir(folder)

    # units

    def _units(self, number: int) -> list[tuple[str, bool]] | None:
        at = f"{self.state}/s{number}/units.json"
        return [tuple(u) for u in json.load(open(at))] if os.path.exists(at) else None

    def _grown(self, before: list[tuple[str, bool]] | None) -> list[tuple[str, bool]]:
        """The units of the next snapshot: those of the last one, so that listings compare, and folders that came above them."""
        if before is None:
            return listing.units(self.root, self.skip, self.hidden, self.wanted)
        known = {f for f, _ in before}
        out = list(before)
        for folder, deep in before:
            if not deep:
                for e in listing.walk(self.root, folder, self.skip, self.hidden, deep=False):
                    if e["kind"] == "directory" and e["path"] not in known and not os.path.islink(os.path.join(self.root, e["path"])):
                        out.append((e["path"], True))
        return out

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        a, b = start["snapshot"], end["snapshot"]
        units = self._units(b)
        if units is None:
            units = self._grown(self._units(a))
            _write(f"{self.state}/s{b}/units.json", lambda fresh: _text(fresh, json.dumps(units)))
        return [Unit(f, deep, f"{self.state}/s{a}/{i}.parquet", f"{self.state}/s{b}/{i}.parquet", a == 0) for i, (f, deep) in enumerate(units)]

    def _listed(self, unit: Unit, before: pa.Table) -> pa.Table:
        if os.path.exists(unit.after):
            return pq.read_table(unit.after)
        rows, unread = [], []
        # a folder that went is empty, one that can't be read is as it was
        gone = not os.path.isdir(os.path.join(self.root, unit.folder)) if unit.folder else False
        for e in () if gone else listing.walk(self.root, unit.folder, self.skip, self.hidden, unit.deep):
            if e["kind"] == "error":
                unread.append(e["path"])
            elif e["kind"] in ("file", "directory"):
                directory = e["kind"] == "directory"
                rows.append((e["path"], directory, "" if directory else f"{e['size_bytes']}:{e['modified_ns']}:{e['file_identity']}"))
        if unread:
            seen = {r[0] for r in rows}
            under = lambda path: any(not u or path == u or path.startswith(f"{u}/") for u in unread)
            rows += [(p, d, m) for p, d, m in zip(*(c.to_pylist() for c in before.columns)) if under(p) and p not in seen]
        made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), _LISTED.types)], schema=_LISTED)
        _write(unit.after, lambda fresh: pq.write_table(made, fresh))
        return made

    def read(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        before = pq.read_table(unit.before) if os.path.exists(unit.before) else _LISTED.empty_table()
        after = self._listed(unit, before)
        if unit.first and not self.existing:
            return
        old, new = ({p: (d, m) for p, d, m in zip(*(c.to_pylist() for c in t.columns))} for t in (before, after))
        events = [(p, True, d) for p, (d, _) in old.items() if p not in new]
        events += [(p, False, v[0]) for p, v in new.items() if old.get(p) != v]
        events.sort()
        for first in range(0, len(events), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*events[first : first + ROWS]), _EVENTS.types)], schema=_EVENTS)


def _text(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema: StructType) -> TreeChangesReader:
        return TreeChangesReader(self.options)


def tree_changes(spark: SparkSession, root: str, state: str, **options) -> DataFrame:
    """The stream of a tree's changes; `state` is a folder of this stream alone."""
    spark.dataSource.register(TreeChanges)
    reader = spark.readStream.format("tree_changes").option("root", root).option("state", state)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
