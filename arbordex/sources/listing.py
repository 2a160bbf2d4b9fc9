"""Project trees as rows: a lister that runs on executors, folder by folder, and file contents through Spark's reader."""

from __future__ import annotations

import itertools
import os
import stat as modes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.functions import classify, text

ENTRIES = (
    "path string, parent_path string, name string, kind string, size_bytes long, modified_ns long, file_identity string, "
    "is_hidden boolean, error string"
)
#: Folders of the engine's caches; a project adds its own tool folders.
SKIPPED = (".godot/imported", ".godot/shader_cache")
#: Folders that the driver opens at most to find enough units of work for all tasks.
OPENED = 2000


def _hidden(entry: os.DirEntry, stat: os.stat_result) -> bool:
    """A leading dot, or the hidden attribute where the platform has one."""
    return entry.name.startswith(".") or bool(getattr(stat, "st_file_attributes", 0) & modes.FILE_ATTRIBUTE_HIDDEN)


def _entered(entry: os.DirEntry, stat: os.stat_result) -> bool:
    """Folders that are no links and, where the platform has them, no reparse points."""
    return entry.is_dir(follow_symlinks=False) and not getattr(stat, "st_file_attributes", 0) & modes.FILE_ATTRIBUTE_REPARSE_POINT


def walk(root: str, start: str, skip: tuple[str, ...], hidden: bool, deep: bool = True) -> Iterator[dict]:
    """The entries below root/start, or right in it. Links are files and not followed; a skipped folder is a row of kind `skipped`
    and not read; what can't be read is an error row."""
    try:
        entries = sorted(os.scandir(os.path.join(root, start)), key=lambda e: e.name)
    except OSError as e:
        yield {"path": start, "kind": "error", "error": str(e)}
        return
    for e in entries:
        path = f"{start}/{e.name}" if start else e.name
        try:
            stat = e.stat(follow_symlinks=False)
            entered, folder = _entered(e, stat), e.is_dir(follow_symlinks=False)
        except OSError as error:
            yield {"path": path, "kind": "error", "error": str(error)}
            continue
        if any(path == s or path.startswith(f"{s}/") for s in skip):
            yield {"path": path, "kind": "skipped" if folder else "skipped_file"}
            continue
        if not hidden and _hidden(e, stat):
            continue
        yield {
            "path": path, "parent_path": start or None, "name": e.name, "kind": "directory" if folder else "file", "size_bytes": 0 if folder else stat.st_size,
            "modified_ns": stat.st_mtime_ns, "file_identity": f"{stat.st_dev:x}:{stat.st_ino:x}" if stat.st_ino else "", "is_hidden": _hidden(e, stat), "error": None,
        }
        if deep and entered:
            yield from walk(root, path, skip, hidden)


def units(root: str, skip: tuple[str, ...], hidden: bool, wanted: int) -> list[tuple[str, bool]]:
    """(folder, whether with all below it): folders are opened, shallow ones first, until there are `wanted` units. So one large top
    folder is many tasks."""
    deep, flat, opened = [""], [], 0
    while deep and len(deep) + len(flat) < wanted and opened < OPENED:
        folder, opened = deep.pop(0), opened + 1
        flat.append(folder)
        deep += [e["path"] for e in walk(root, folder, skip, hidden, deep=False) if e["kind"] == "directory" and not os.path.islink(os.path.join(root, e["path"]))]
    return [(f, False) for f in flat] + [(d, True) for d in deep]


def listed(spark: SparkSession, root: str, *, skip: tuple[str, ...] = SKIPPED, hidden: bool = True) -> DataFrame:
    """ENTRIES of a tree that all executors can reach, with rows of kind `error`, `skipped` and `skipped_file`, in no order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ENTRIES))
    tasks = spark.sparkContext.defaultParallelism

    def run(batches):
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = walk(root, folder, skip, hidden, deep)
                while rows := list(itertools.islice(found, 10_000)):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    starts = spark.createDataFrame(units(root, skip, hidden, 4 * tasks), "folder string, deep boolean").repartition(4 * tasks)
    return starts.mapInArrow(run, ENTRIES)


def typed(found: DataFrame) -> DataFrame:
    """Entries with extension, file_type and engine_type."""
    directory = F.col("kind") == "directory"
    return found.where(F.col("kind").isin("file", "directory")).drop("error").select(
        "*",
        text.extension_of(F.col("path")).alias("extension"),
        classify.file_type(F.col("path"), directory).alias("file_type"),
        classify.type_hint(F.col("path"), directory).alias("engine_type"),
        directory.alias("is_directory"),
    )


def entries(spark: SparkSession, root: str, *, skip: tuple[str, ...] = SKIPPED, hidden: bool = True) -> DataFrame:
    """The typed entries of a tree, ordered by path bytes, then kind."""
    return typed(listed(spark, root, skip=skip, hidden=hidden)).orderBy("path", "kind")

