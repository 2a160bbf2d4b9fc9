"""A tree of files as a data source that reads only what is asked for.

`tree(spark, root)` gives FILES. Filters on path, folder, extension and size reach the source:

- `path = ...` or `path IN (...)`: no folder is listed, and only these files are looked at and opened;
- `startswith(path, ...)` and `parent_path = ...`: only units of the tree that can hold such paths are listed;
- `extension = ...`, `extension IN (...)` and bounds of `size_bytes`: files that do not fit are listed but not opened.

A file is read up to `limit` bytes and one more, by which a parser sees that there was more; without the option `content` (true) files are not
opened at all. Files go to tasks by unit, or some paths at a time. What can't be read has a null content. `opened` does the same
for paths that are rows of a DataFrame, however many.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from arbordex.functions import text
from arbordex.sources import listing

FILES = "path string, parent_path string, name string, extension string, size_bytes long, modified_ns long, content binary"
#: Fixed value: bytes of a file that the largest tier of the parsers reads.
LIMIT = 8 << 20
#: Asked paths of one task, and bytes of one batch to Spark.
PATHS = 256
BATCH_BYTES = 4 << 20
#: Files that are worth a task of their own.
FILES_OF_TASK = 32
_ARROW = pa.schema([("path", pa.string()), ("parent_path", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("size_bytes", pa.int64()), ("modified_ns", pa.int64()), ("content", pa.binary())])


def read_file(root: str, path: str, limit: int) -> bytes | None:
    """At most `limit` bytes of a file and one more; None if it can't be read."""
    try:
        with open(os.path.join(root, path), "rb", buffering=0) as f:
            parts, left = [], limit + 1
            while left > 0 and (part := f.read(left)):
                parts.append(part)
                left -= len(part)
            return b"".join(parts)
    except OSError:
        return None


def extension_of(name: str) -> str:
    """The ASCII-folded extension with its dot; none for names that begin or end with their only dot."""
    at = name.rfind(".")
    return name[at:].translate(_FOLD) if 0 < at < len(name) - 1 else ""


_FOLD = str.maketrans(text.UPPER, text.LOWER)


@dataclass
class Unit(InputPartition):
    """A folder (deep: with all below it), or some paths."""

    folder: str = ""
    deep: bool = False
    paths: tuple[str, ...] | None = None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].removeprefix("file://").rstrip("/")
        self.skip = tuple(s for s in options.get("skip", ",".join(listing.SKIPPED)).split(",") if s)
        self.hidden = options.get("hidden", "true").lower() == "true"
        self.limit, self.content = int(options.get("limit", LIMIT)), options.get("content", "true").lower() == "true"
        self.wanted = int(options.get("units", "64"))
        self.paths: set[str] | None = None
        self.extensions: set[str] | None = None
        self.folder: str | None = None
        self.prefix = ""
        self.least, self.most = 0, 1 << 63

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "path" and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif column == "extension" and values is not None:
                self.extensions = values if self.extensions is None else self.extensions & values
            elif column == "parent_path" and isinstance(f, EqualTo) and self.folder in (None, f.value):
                self.folder = f.value
            elif column == "path" and isinstance(f, StringStartsWith) and (f.value.startswith(self.prefix) or self.prefix.startswith(f.value)):
                self.prefix = max(self.prefix, f.value, key=len)
            elif column == "size_bytes" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            elif column == "size_bytes" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif not (column == "path" and isinstance(f, IsNotNull)):
                yield f

    def _held(self, unit: tuple[str, bool]) -> bool:
        """Whether a unit can hold a path that is asked for."""
        folder, deep = unit
        for wanted, whole in ((self.prefix, False), (f"{self.folder}/" if self.folder else "", True)):
            if not wanted:
                continue
            inside = f"{folder}/" if folder else ""
            if deep and not (wanted.startswith(inside) or inside.startswith(wanted)):
                return False
            # a single folder's files lie right in it
            if not deep and not (inside == wanted if whole else inside.startswith(wanted) or (wanted.startswith(inside) and "/" not in wanted[len(inside) :])):
                return False
        return True

    def partitions(self) -> list[Unit]:
        if self.paths is not None:
            # "a//b" and "./a" are no paths of a tree
            some = sorted(p for p in self.paths if p and os.path.normpath(p) == p and not p.startswith(("/", "../")))
            return [Unit(paths=tuple(some[i : i + PATHS])) for i in range(0, len(some), PATHS)] or [Unit(paths=())]
        found = [Unit(folder, deep) for folder, deep in listing.units(self.root, self.skip, self.hidden, self.wanted) if self._held((folder, deep))]
        return found or [Unit(paths=())]

    def _asked(self, path: str, name: str) -> bool:
        if self.extensions is not None and extension_of(name) not in self.extensions:
            return False
        return path.startswith(self.prefix) and (self.folder is None or (path.rpartition("/")[0] or None) == self.folder)

    def _entries(self, unit: Unit) -> Iterator[tuple[str, int, int]]:
        """(path, size, time) of the asked files of a unit."""
        if unit.paths is None:
            for e in listing.walk(self.root, unit.folder, self.skip, self.hidden, unit.deep):
                if e["kind"] == "file" and self._asked(e["path"], e["name"]):
                    yield e["path"], e["size_bytes"], e["modified_ns"]
            return
        for path in unit.paths:
            if any(path == s or path.startswith(f"{s}/") for s in self.skip) or not self._asked(path, path.rpartition("/")[2]):
                continue
            if not self.hidden and any(part.startswith(".") for part in path.split("/")):
                continue
            try:
                stat = os.lstat(os.path.join(self.root, path))
            except OSError:
                continue
            if not os.path.isdir(os.path.join(self.root, path)) or os.path.islink(os.path.join(self.root, path)):
                yield path, stat.st_size, stat.st_mtime_ns

    def read(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, n, modified in self._entries(unit):
            if not self.least <= n <= self.most:
                continue
            folder, _, name = path.rpartition("/")
            content = read_file(self.root, path, self.limit) if self.content else None
            rows.append((path, folder or None, name, extension_of(name), n, modified, content))
            size += len(content or b"") + 200
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class ProjectTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of a tree (FILES); filters are pushed into the listing. Spark plans a Python source anew only for a query that pushes
    some filter, and would else read with the filters of the last query on the same frame; so one filter that all paths pass is always
    there."""
    spark.dataSource.register(ProjectTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; it concerns Python sources alone
    return spark.read.format("project_tree").option("root", root).options(**{k: str(v) for k, v in options.items()}).load().where("path IS NOT NULL")


def opened(paths: DataFrame, root: str, limit: int = LIMIT) -> DataFrame:
    """(path, extension, content) of the files that are named by the rows of `paths` (path); no other file is looked at."""
    base = root.removeprefix("file://").rstrip("/")

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for path in b.column(0).to_pylist():
                content = read_file(base, path, limit)
                rows.append((path, extension_of(path.rpartition("/")[2]), content))
                size += len(content or b"") + 100
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names)

    names = ["path", "extension", "content"]
    return paths.select("path").mapInArrow(run, "path string, extension string, content binary")


def dealt(paths: DataFrame, files: int | None = None) -> DataFrame:
    """Paths dealt evenly to tasks by their hash, as a few folders may hold most of them. How many tasks is told, by how many files there
    are if that is known: paths are short, so Spark would take many files for one small task."""
    most = 4 * paths.sparkSession.sparkContext.defaultParallelism
    tasks = most if files is None else max(1, min(most, files // FILES_OF_TASK))
    return paths.repartition(tasks, F.xxhash64("path"))
