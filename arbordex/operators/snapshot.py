"""What changed between the last snapshot and a scan, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordex.functions.text import ancestors, under_any

CLEAN = "clean"
#: Dirty paths that a plan holds as literals; more are rows of a table.
LITERALS = 64


def dirty_reason(old: str, new: str, *, versions: dict[str, int] | None = None, force: bool = False) -> Column:
    """The first reason that holds, for rows of a left join of a scan (`new`) with a snapshot (`old`); prefixes of columns.

    A path without snapshot is new even in a forced scan. Directories have no size or time worth comparing.
    """
    o, n = lambda c: F.col(f"{old}{c}"), lambda c: F.col(f"{new}{c}")
    out = F.when(o("path").isNull(), "new_path")
    if force:
        return out.otherwise("force_rescan")
    is_file = n("kind") == "file"
    out = (
        out.when(o("kind") != n("kind"), "kind_changed")
        .when(is_file & (o("size_bytes") != n("size_bytes")), "size_changed")
        .when(is_file & (o("modified_ns") != n("modified_ns")), "modified_time_changed")
        .when((o("file_identity") != "") & (n("file_identity") != "") & (o("file_identity") != n("file_identity")), "file_identity_changed")
    )
    for name, now in (versions or {}).items():
        out = out.when(o(f"{name}_version") != now, f"{name}_version_changed")
    return out.when(o("parse_status").isin("io_error", "malformed"), "prior_parse_failed_retry").otherwise(CLEAN)


def diff(scan: DataFrame, snapshot: DataFrame, *, versions: dict[str, int] | None = None, force: bool = False, dirty_paths: list[str] | None = None, scene_version: int | None = None) -> DataFrame:
    """scan with `dirty_reason`. With dirty paths, known paths are judged by them alone; a scene parser's new version overrides all."""
    old = snapshot.select([F.col(c).alias(f"old_{c}") for c in snapshot.columns])
    joined = scan.join(old, F.col("path") == F.col("old_path"), "left")
    reason = dirty_reason("old_", "", versions=versions, force=force)
    if dirty_paths and not force:
        known, hit = F.col("old_path").isNotNull(), under_any(F.col("path"), dirty_paths) if len(dirty_paths) <= LITERALS else F.col("_hit")
        if len(dirty_paths) > LITERALS:
            joined = joined.join(below(scan, dirty_paths), "path", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        reason = F.when(known & hit, "watcher_invalidated").when(known, CLEAN).otherwise(reason)
    if scene_version is not None:
        stale = F.col("old_path").isNotNull() & F.col("path").rlike(r"\.(tscn|scn)$") & (F.col("old_scene_parser_version") != scene_version)
        reason = F.when(stale, "scene_parser_version_changed").otherwise(reason)
    return joined.select(*[F.col(c) for c in scan.columns], reason.alias("dirty_reason"))


def below(scan: DataFrame, paths: list[str]) -> DataFrame:
    """(path, _hit) of the scan's paths that are one of `paths` or below one: ancestors are looked up in a table of the paths."""
    told = scan.sparkSession.createDataFrame([(p,) for p in sorted(set(paths))], "_up string")
    up = scan.select("path", F.explode(ancestors(F.col("path"))).alias("_up"))
    return up.join(told, "_up", "left_semi").select("path").distinct().withColumn("_hit", F.lit(True))


def reason_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("dirty_reason").agg(F.count("*").alias("n"))


def new_rows(scan: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return scan.join(files.select(key), key, "left_anti")


def known_rows(scan: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    return scan.join(files.select(key), key, "left_semi")
