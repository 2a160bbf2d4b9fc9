"""Writing a scan into the tables: upserts, tombstones, cascades. Each takes the old table and gives the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.functions.text import ancestors
from arbordex.operators.snapshot import CLEAN


def upsert(files: DataFrame, changed: DataFrame, values: list[str], generation: int, key: str = "path") -> DataFrame:
    """The files after a scan: new rows in, dirty rows updated and undeleted, clean rows only seen again, others as they were.

    `changed` has key, values and dirty_reason; `files` has key, values, first_seen, last_seen, is_deleted. One full outer join.
    """
    s, f = changed.alias("s"), files.alias("f")
    seen, known = F.col("s.dirty_reason").isNotNull(), F.col("f.first_seen").isNotNull()
    take = seen & (~known | (F.col("s.dirty_reason") != CLEAN))
    return f.join(s, key, "full").select(
        key,
        *[F.when(take, F.col(f"s.{v}")).otherwise(F.col(f"f.{v}")).alias(v) for v in values],
        F.coalesce(F.col("f.first_seen"), F.lit(generation)).cast("long").alias("first_seen"),
        F.when(seen, F.lit(generation)).otherwise(F.col("f.last_seen")).cast("long").alias("last_seen"),
        F.when(take, F.lit(False)).otherwise(F.col("f.is_deleted")).alias("is_deleted"),
        F.when(~seen, "unseen").when(~known, "inserted").when(take, "updated").otherwise("refreshed").alias("merge_state"),
    )


def tombstone(files: DataFrame, generation: int, unread: DataFrame | None = None) -> DataFrame:
    """Rows that the scan of `generation` did not see become deleted, with their reason; those at or below a path of `unread` (path),
    which the scan could not look at, stay."""
    gone = ~F.col("is_deleted") & (F.col("last_seen") != generation)
    if unread is not None:
        unseen = files.where(gone).select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("_up"))
        spared = unseen.join(unread.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select("path").distinct().withColumn("_spared", F.lit(True))
        files, gone = files.join(spared, "path", "left"), gone & F.col("_spared").isNull()
    marked = files.withColumn("dirty_reason", F.when(gone, "deleted_path").otherwise(F.lit(""))).withColumn("is_deleted", F.col("is_deleted") | gone)
    return marked.drop("_spared")


def deleted_log(log: DataFrame, files: DataFrame, generation: int, key: str = "path") -> DataFrame:
    """The log with the paths that this generation deleted; a path and generation is logged once."""
    fresh = files.where(F.col("is_deleted") & (F.col("dirty_reason") == "deleted_path")).select(key, F.lit(generation).cast("long").alias("generation"))
    return log.unionByName(fresh.join(log, [key, "generation"], "left_anti"))


def replace_children(children: DataFrame, fresh: DataFrame, parsed: DataFrame, parent: str = "file_id") -> DataFrame:
    """The children of parents that were parsed again are those of the parse; all others stay."""
    return children.join(parsed.select(parent), parent, "left_anti").unionByName(fresh)


def class_registry(declared: DataFrame, key: str = "class_name", order: str = "path") -> DataFrame:
    """One row for each class name; of several declarations the one with the last path."""
    return declared.groupBy(key).agg(F.max_by(F.struct(*[c for c in declared.columns if c != key]), order).alias("row")).select(key, "row.*")


def stale_classes(classes: DataFrame, files: DataFrame) -> DataFrame:
    """Classes whose file is gone."""
    return classes.join(files.where(~F.col("is_deleted")).select(F.col("path").alias("script_path")), "script_path", "left_anti")


def invalidate_targets(edges: DataFrame, files: DataFrame, target: str = "target_id") -> DataFrame:
    """Edges whose target file is deleted or unknown lose it and become unresolved."""
    alive = files.where(~F.col("is_deleted")).select(F.col("id").alias(target), F.lit(True).alias("_alive"))
    lost = F.col(target).isNotNull() & F.col("_alive").isNull()
    joined = edges.join(alive, target, "left")
    columns = {c: F.col(c) for c in edges.columns} | {target: F.when(~lost, F.col(target)), "is_resolved": F.col("is_resolved") & ~lost, "is_unresolved": F.col("is_unresolved") | lost}
    return joined.select(*[columns[c].alias(c) for c in edges.columns])


def drop_orphans(children: DataFrame, files: DataFrame, owner: str = "file_id") -> DataFrame:
    """Children of deleted files go."""
    return children.join(files.where(~F.col("is_deleted")).select(F.col("id").alias(owner)), owner, "left_semi")


def without(children: DataFrame, deleted: DataFrame, owner: str = "file_id") -> DataFrame:
    """Children of the files of `deleted` (id) go."""
    return children.join(deleted.select(F.col("id").alias(owner)), owner, "left_anti")


def let_go(edges: DataFrame, deleted: DataFrame, target: str = "target_id") -> DataFrame:
    """Edges whose target file is one of `deleted` (id) lose it and become unresolved."""
    gone = deleted.select(F.col("id").alias(target), F.lit(True).alias("_gone"))
    lost = F.col("_gone").isNotNull()
    joined = edges.join(gone, target, "left")
    columns = {c: F.col(c) for c in edges.columns} | {target: F.when(~lost, F.col(target)), "is_resolved": F.col("is_resolved") & ~lost, "is_unresolved": F.col("is_unresolved") | lost}
    return joined.select(*[columns[c].alias(c) for c in edges.columns])


def prune(rows: DataFrame, imported: DataFrame, key: str | list[str], run: int) -> DataFrame:
    """An import's rows replace the table's: known keys keep first_seen, keys that it lacks go."""
    old = rows.select(*([key] if isinstance(key, str) else key), F.col("first_seen").alias("_first"))
    return imported.join(old, key, "left").select(*imported.columns, F.coalesce("_first", F.lit(run)).cast("long").alias("first_seen"), F.lit(run).cast("long").alias("last_seen"))


def register(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a registration (uid, root) does with the known projects (id, uid, root): insert, update (a moved root may change), or
    the conflict that forbids it."""
    by_uid = projects.select(F.col("uid"), F.col("id").alias("uid_id"))
    by_root = projects.select(F.col("root"), F.col("id").alias("root_id"), F.col("uid").alias("root_uid"))
    return wanted.join(by_uid, "uid", "left").join(by_root, "root", "left").select(
        "uid",
        "root",
        F.coalesce("uid_id", "root_id").alias("project_id"),
        F.when(F.col("uid") == "", "error_empty_uid")
        .when(F.col("root") == "", "error_empty_root")
        .when(F.col("uid_id") != F.col("root_id"), "error_two_projects")
        .when(F.col("uid_id").isNull() & F.col("root_id").isNotNull(), "error_root_taken")
        .when(F.col("uid_id").isNotNull(), "update")
        .otherwise("insert")
        .alias("action"),
    )
