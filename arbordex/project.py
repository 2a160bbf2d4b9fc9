"""A project's inventory on disk, and the questions that can be asked of it.

A scan writes the tables that it changes into a folder of its own and then publishes a version that names them, so a failed or
cancelled scan changes nothing but its own run row. Questions return DataFrames; bad ids give empty ones.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arbordex.functions import text
from arbordex.operators import graph, inventory, merge, pages, resolve, rows, snapshot, summary
from arbordex.operators.lineage import numbered
from arbordex.sources import imports, listing, scripts, tree
from arbordex.store import BUCKETED, METRICS, SCHEMAS, Store, bucket, shaped
from arbordex.streaming.changes import Watcher
from arbordex.streaming.tree_changes import tree_changes

#: Versions that make a file dirty when they change.
VERSIONS = {"parser": 2, "dependency_parser": 1, "classifier": 2}
SCENE_VERSION = 1
VALUES = (
    "parent_path name kind size_bytes modified_ns file_identity is_hidden extension file_type engine_type is_directory "
    "parser_version dependency_parser_version scene_parser_version classifier_version"
).split()
_SCRIPT_TABLES = ("symbols", "classes", "dependencies", "references", "doc_comments")
_SCENE_TABLES = ("resources", "attachments")
#: The tables whose rows point to a file besides their own.
_TARGETS = {"dependencies": "target_id", "references": "target_id", "attachments": "script_id"}
#: The sort keys of lists; other keys mean the first.
SORTS = {"files": ("path", "name", "modified_time", "file_type"), "classes": ("class_name", "script_path", "base_type")}
#: Pages under a filter that end before this row come of one pass that keeps the first rows, later ones of laid orders.
NEAR = 10 * inventory.PAGE
SYMBOL_SEARCH = ("name", "qualified_name", "symbol_name", "class_name", "signature")


class Cancelled(Exception):
    """The scan was cancelled."""


class Scan:
    """One scan on its way from a listing to a version."""

    def __init__(self, project: Project, number: int, began: float):
        self.project, self.number, self.began, self.spark = project, number, began, project.spark
        self.folder = f"g{number}-{uuid.uuid4().hex[:8]}"
        self.old = project.store.current()
        self.buckets = project.store.buckets(self.old)
        self.tables = dict(self.old["tables"])
        self.metrics: dict[str, int] = {}

    def renumber(self) -> None:
        """Go on from the version that is current now, under the number after it."""
        self.old = self.project.store.current()
        self.number = self.old["number"] + 1
        self.folder = f"g{self.number}-{uuid.uuid4().hex[:8]}"

    def before(self, name: str) -> DataFrame:
        return self.project.store.table(name, self.old)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table of this scan; intermediate results have names that begin with `_`."""
        self.project.check()
        made = self.project.store.write(self.folder, name, shaped(name, df) if name in SCHEMAS else df)
        if name in SCHEMAS:
            self.tables[name] = f"{self.folder}/{name}"
        return made

    def told(self, name: str, df: DataFrame, *told: Column) -> tuple[DataFrame, dict[str, Any]]:
        """(a table of this scan, aggregates of its rows): the job that writes the table observes them, so none reads it again."""
        seen = Observation()
        made = self.keep(name, (shaped(name, df) if name in SCHEMAS else df).observe(seen, *told))
        return made, {k: v or 0 for k, v in seen.get.items()}

    def together(self, tasks: dict[str, Callable[[], Any]]) -> dict[str, Any]:
        """Independent tables side by side; each is a job of its own."""
        with ThreadPoolExecutor(4) as pool:
            running = {name: pool.submit(inheritable_thread_target(self.spark)(task)) for name, task in tasks.items()}
            return {name: f.result() for name, f in running.items()}

    def timed(self, name: str) -> None:
        now = time.time()
        self.metrics[name] = int(1000 * (now - self.began)) - sum(self.metrics.get(m, 0) for m in METRICS[-5:-1])

    def list(self, listed: DataFrame, diff: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(entries with their reasons, rows of what was skipped or could not be read), both of one table, and what they count."""
        others = listed.where(~F.col("kind").isin("file", "directory")).select("path", "kind", "error")
        entry, is_file, dirty = F.col("kind").isin("file", "directory"), F.col("kind") == "file", F.col("dirty_reason") != snapshot.CLEAN
        script, scene = (is_file & F.col("extension").isin(*e) for e in (list(scripts.LANGUAGES), scripts.SCENES))
        every, found = self.told(
            "_changed",
            diff(listed).unionByName(others, allowMissingColumns=True),
            F.count_if(is_file).alias("files_seen"),
            F.count_if(F.col("kind") == "directory").alias("dirs_seen"),
            F.count_if(F.col("kind") == "skipped").alias("dirs_skipped"),
            F.count_if(F.col("kind") == "error").alias("errors"),
            F.count_if(entry & ~dirty).alias("entries_clean"),
            F.count_if(entry & dirty).alias("entries_dirty"),
            F.count_if(F.col("dirty_reason") == "new_path").alias("entries_new"),
            F.count_if(script).alias("scripts_candidates"),
            F.count_if(script & ~dirty).alias("scripts_skipped_clean"),
            F.count_if(scene & ~dirty).alias("scenes_skipped_clean"),
            F.count_if((script | scene) & dirty).alias("to_parse"),
        )
        self.metrics |= found
        self.timed("traversal_ms")
        return every.where(entry).drop("error"), every.where(~entry)

    def parse(self, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The scripts and scenes that are dirty, parsed."""
        if not self.metrics["to_parse"]:
            self.metrics |= {"scripts_parsed": 0, "scenes_parsed": 0}
            return (self.spark.createDataFrame([], f"path string, {schema}") for schema in (scripts.SCRIPT, scripts.SCENE))
        dirty = changed.where("dirty_reason <> 'clean' and kind = 'file'")
        # each job opens its own files alone
        content = lambda kinds: tree.opened(tree.dealt(dirty.where(F.col("extension").isin(*kinds)), self.metrics["to_parse"]), self.project.root)
        sizes = [F.sum(F.size(c)).alias(n) for c, n in (("symbols", "symbols_created"), ("references", "references_created"), ("doc_comments", "doc_comments_created"), ("dependencies", "dependencies_created"))]
        made = self.together(
            {
                "_scripts": lambda: self.told(
                    "_scripts",
                    scripts.parse_scripts(content(scripts.LANGUAGES)),
                    F.count(F.lit(1)).alias("scripts_parsed"),
                    *[F.sum(c).alias(c) for c in ("lines_scanned", "bytes_read", "tokens_generated")],
                    F.count_if(F.col("limit_exceeded")).alias("limit_exceeded"),
                    F.sum(F.size(F.filter("dependencies", lambda d: d["is_dynamic"]))).alias("dynamic_dependencies"),
                    *sizes,
                ),
                "_scenes": lambda: self.told("_scenes", scripts.parse_scenes(content(scripts.SCENES)), F.count(F.lit(1)).alias("scenes_parsed"), F.sum(F.size("script_attachments")).alias("attachments_created")),
            }
        )
        (parsed, of_scripts), (scenes, of_scenes) = made["_scripts"], made["_scenes"]
        self.metrics |= of_scripts | of_scenes
        self.timed("parse_ms")
        return parsed, scenes

    def merge(self, changed: DataFrame, parsed: DataFrame, unread: DataFrame | None) -> DataFrame:
        """The files table: upsert, statuses, tombstones, ids and parents. Files below a folder that could not be read stay."""
        old, found = self.before("files"), self.metrics
        files = merge.tombstone(merge.upsert(old, changed, VALUES, self.number), self.number, unread)
        files = files.join(old.select("path", "id", F.col("parse_status").alias("_before")), "path", "left")
        status = F.coalesce(F.col("_before"), F.lit("not_parsed"))
        if found["scripts_parsed"]:
            files, status = files.join(parsed.select("path", F.col("status").alias("_status")), "path", "left"), F.coalesce(F.col("_status"), status)
        files = files.withColumn("parse_status", status).drop("_status", "_before")
        found["inserted"] = 0
        if found["entries_new"]:
            # only new rows need numbers, and only they are numbered in order
            files = self.keep("_merged", files)
            found["inserted"] = files.where("id is null").count()
        if found["inserted"]:
            top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            files = files.where("id is not null").unionByName(numbered(files.where("id is null").drop("id"), "path", top + 1))
        numbers = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("dirty_reason") == "deleted_path").alias("gone"))
        files, total = self.told("files", resolve.parents(files.withColumn("parent_id", F.lit(0).cast("long"))), *numbers)
        found |= {"updated": found["entries_dirty"] - found["inserted"], "refreshed": found["entries_clean"], "snapshot_entries": total["n"] - found["inserted"], "entries_deleted": total["gone"]}
        if total["gone"] or "deleted_log" not in self.tables:
            self.keep("deleted_log", merge.deleted_log(self.before("deleted_log"), files, self.number))
        self.timed("merge_ms")
        return files

    def _buckets(self, name: str, *keys: DataFrame) -> set[int]:
        """The buckets of a table that keys (one column each) fall into."""
        found = [k.select(bucket(name, self.buckets, F.col(k.columns[0])).alias("b")) for k in keys]
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return {r[0] for r in every.distinct().collect()}

    def rewrite(self, name: str, touched: set[int], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Write the touched buckets of a table anew, made of what they held; all others stay where they are."""
        self.project.check()
        old = self.tables.get(name) or {}
        if isinstance(old, str):  # a table that was whole before goes into buckets
            old, touched = {}, set(range(self.buckets))
        if touched or name not in self.tables:
            fresh = self.project.store.write_buckets(self.folder, name, shaped(name, make(self.project.store.table(name, self.old, touched))), self.buckets)
            self.tables[name] = {k: at for k, at in old.items() if int(k) not in touched} | fresh
            self.metrics["buckets_written"] = self.metrics.get("buckets_written", 0) + len(touched)
        return self.project.store.table(name, {"tables": self.tables})

    def scripts(self, files: DataFrame, parsed: DataFrame, deleted: DataFrame) -> None:
        """The tables of scripts: those parsed again are replaced, those of deleted files go, targets that went are let go."""
        again, owned = parsed.join(files.where("not is_deleted").select("path", F.col("id").alias("file_id")), "path"), set()
        if self.metrics["scripts_parsed"]:
            again, seen = self.told("_again", again, F.collect_set(bucket("symbols", self.buckets)).alias("owned"))
            owned |= set(seen["owned"] or ())
        gone, few = again.select("file_id"), self.metrics["scripts_parsed"] * 4 < self.metrics["scripts_candidates"]
        owned |= self._buckets("symbols", deleted) if self.metrics["entries_deleted"] else set()
        left = lambda old: merge.without(old.join(gone, "file_id", "left_anti"), deleted)
        docs = again.select("file_id", F.explode("doc_comments").alias("c")).select(
            "file_id", _id(F.col("c.symbol_local_id")).alias("symbol_id"), "c.is_attached", F.col("c.comment_style").alias("style"),
            "c.comment_text", "c.summary_text", "c.text_hash", F.col("c.line_start").alias("line"),
        )

        def declarations() -> DataFrame:
            declared = shaped("classes", again.where("class_name <> ''").select("class_name", F.col("path").alias("script_path"), "file_id", "language", F.col("direct_base_type").alias("base_type"), "is_node_type", "is_resource_type"))
            went = self.before("classes").join(gone.unionByName(deleted.select(F.col("id").alias("file_id"))), "file_id", "left_semi")
            named = self._buckets("classes", went.select("class_name"), declared.select("class_name"))
            return self.rewrite("classes", named, lambda old: merge.class_registry(left(old).unionByName(declared), order="script_path"))

        made = self.together(
            {
                "symbols": lambda: self.rewrite("symbols", owned, lambda old: left(old).unionByName(shaped("symbols", _symbols(again)))),
                "classes": declarations,
                "docs": lambda: self.rewrite("doc_comments", owned, lambda old: left(old).unionByName(shaped("doc_comments", docs))),
            }
        )
        symbols, classes = made["symbols"], made["classes"]
        own = self.project.store.table("symbols", {"tables": self.tables}, owned)

        def edges(name: str, kind: str) -> DataFrame:
            found = resolve.target_by_class(resolve.target_by_path(_edges(again, name, kind), files), symbols, ["name", "symbol_name", "class_name"], few)
            if name == "dependencies":
                found = resolve.resolution(resolve.target_by_declaration(found, classes)).withColumn("target_symbol_id", F.lit(None).cast("long"))
            else:
                found = resolve.resolution(resolve.target_symbol(found, symbols, ["name", "symbol_name"], few))
            fresh = merge.invalidate_targets(shaped(name, resolve.source_symbol(found, own)), files)
            touched = owned | self._targets(name, deleted)
            return self.rewrite(name, touched, lambda old: merge.let_go(left(old), deleted).unionByName(fresh))

        made = self.together({"unresolved": lambda: edges("dependencies", "dependency_kind").where("is_unresolved").count(), "references": lambda: edges("references", "reference_kind")})
        self.metrics["unresolved_dependencies"] = made["unresolved"]

    def _targets(self, name: str, deleted: DataFrame, target: str = "target_id") -> set[int]:
        """The buckets of edges whose target went."""
        if not self.metrics["entries_deleted"]:
            return set()
        lost = self.before(name).join(deleted.select(F.col("id").alias(target)), target, "left_semi")
        return self._buckets(name, lost.select(BUCKETED[name]))

    def scenes(self, files: DataFrame, scenes: DataFrame, deleted: DataFrame) -> None:
        """The tables of scenes. A resource's file and an attachment's script and class are bound by path."""
        ids = files.where("not is_deleted").select("path", F.col("id").alias("scene_id"))
        seen = scenes.join(ids, "path")
        over, named = seen.select("scene_id"), ids.withColumnsRenamed({"path": "at", "scene_id": "found_id"})
        owned = self._buckets("resources", over, deleted)
        left = lambda old: merge.without(old.join(over, "scene_id", "left_anti"), deleted, "scene_id")
        resources = seen.select("scene_id", F.posexplode("external_resources").alias("slot", "r")).select(
            "scene_id", F.col("r.ext_resource_id").alias("resource_id"), "slot", F.col("r.resource_type").alias("type"),
            F.col("r.resource_path").alias("path"), F.col("r.resource_uid").alias("uid"),
        )
        resources = resources.join(named, F.col("path") == F.col("at"), "left").withColumn("target_id", F.col("found_id")).withColumn("is_resolved", F.col("found_id").isNotNull())
        self.rewrite("resources", owned, lambda old: left(old).unionByName(shaped("resources", resources)))
        hung = seen.select("scene_id", F.explode("script_attachments").alias("a")).select(
            "scene_id", "a.node_path", "a.node_name", "a.node_type", F.col("a.ext_resource_id").alias("resource_id"), "a.attachment_kind",
            F.col("a.script_project_relative_path").alias("script_path"), "a.script_uid", "a.is_dynamic", "a.line",
        )
        own = self.project.store.table("resources", {"tables": self.tables}, owned)
        hung = resolve.fill_attachments(hung, own).join(named, F.col("script_path") == F.col("at"), "left").withColumn("script_id", F.col("found_id"))
        hung = resolve.class_symbol(hung, self.project.store.table("symbols", {"tables": self.tables}))
        hung = hung.withColumn("is_resolved", F.col("script_id").isNotNull()).withColumn("is_unresolved", F.col("script_id").isNull() & ~F.col("is_dynamic"))
        fresh = merge.invalidate_targets(shaped("attachments", hung), files, "script_id")
        touched = owned | self._targets("attachments", deleted, "script_id")
        self.rewrite("attachments", touched, lambda old: merge.let_go(left(old), deleted, "script_id").unionByName(fresh))

    def finish(self, status: str, error: str = "") -> DataFrame:
        """Publish the tables with this run's row; of a scan that ended early the row alone."""
        self.metrics["wall_ms"] = int(1000 * (time.time() - self.began))
        row = self.spark.createDataFrame([(self.number, status, error, *(int(self.metrics.get(m) or 0) for m in METRICS))], SCHEMAS["metrics"])
        tables = self.tables if status == "completed" else dict(self.old["tables"])
        self.project.store.write(self.folder, "metrics", self.before("metrics").unionByName(row).coalesce(1))
        self.project.store.publish(self.number, tables | {"metrics": f"{self.folder}/metrics"}, buckets=self.buckets)
        return row


def _letting_go(lost: DataFrame, owner: str, target: str | None) -> Callable[[DataFrame], DataFrame]:
    """What a table keeps when files (id) go: rows of other owners, without targets among them."""
    return lambda old: merge.let_go(merge.without(old, lost, owner), lost, target) if target else merge.without(old, lost, owner)


def _id(slot) -> Any:
    """A symbol's id: its file's, and its place in the file."""
    return F.col("file_id") * 1_000_000 + slot


def _symbols(again: DataFrame) -> DataFrame:
    return again.select("file_id", F.explode("symbols").alias("s")).select(
        _id(F.col("s.local_symbol_id")).alias("id"), "file_id", F.col("s.local_symbol_id").alias("slot"),
        _id(F.col("s.parent_local_symbol_id")).alias("parent_id"), F.col("s.parent_local_symbol_id").alias("parent_slot"),
        F.col("s.symbol_kind").alias("kind"), "s.name", "s.qualified_name", "s.symbol_name", "s.class_name", "s.language",
        "s.declared_type", "s.return_type", F.col("s.default_value_excerpt").alias("default_value"),
        F.col("s.signature_text").alias("signature"), F.col("s.doc_comment_state").alias("doc_state"),
        F.col("s.symbol_flags").alias("flags"), F.col("s.line_start").alias("line"), F.col("s.column_start").alias("column"),
    )


def _edges(again: DataFrame, name: str, kind: str) -> DataFrame:
    return again.select("file_id", F.explode(name).alias("d")).select(
        "file_id", F.col(f"d.{kind}").alias("kind"), "d.reference_text", text.confidence_milli(F.col("d.confidence")).alias("confidence_milli"),
        "d.is_dynamic", F.col("d.line_start").alias("line"), F.col("d.column_start").alias("column"),
        F.col("d.source_symbol_local_id").alias("slot"), F.col("d.target_project_relative_path").alias("target_path"),
        F.col("d.target_class_name").alias("target_class"), F.col("d.target_symbol_name").alias("target_name"),
        F.col("d.target_resource_uid").alias("target_uid"),
    )


class Project:
    """One project: scans that keep its tables up to date, and the lists over them."""

    def __init__(self, spark: SparkSession, root: str, folder: str, skip: tuple[str, ...] = listing.SKIPPED):
        self.spark, self.root, self.skip, self.store, self.last_error = spark, root, skip, Store(spark, folder), ""
        self.group, self._stop, self.watcher = f"scan-{uuid.uuid4().hex}", False, Watcher(spark)

    # scans

    def entries(self, hidden: bool = True) -> DataFrame:
        return listing.entries(self.spark, self.root, skip=self.skip, hidden=hidden)

    def _diff(self, found: DataFrame, files: DataFrame, force: bool, dirty_paths: list[str] | None) -> DataFrame:
        stamps = {f"{k}_version": F.lit(v) for k, v in {**VERSIONS, "scene_parser": SCENE_VERSION}.items()}
        changed = snapshot.diff(listing.typed(found), files.where("not is_deleted"), versions=VERSIONS, force=force, dirty_paths=dirty_paths, scene_version=SCENE_VERSION)
        return changed.withColumns(stamps)

    def scan(self, *, force: bool = False, dirty_paths: list[str] | None = None, hidden: bool = True, limit: int | None = None, persist: bool = True) -> DataFrame:
        """Scan the tree. Persisted: the run's metrics row. Otherwise the entries with their dirty reasons, nothing written."""
        began, self._stop = time.time(), False
        found = listing.listed(self.spark, self.root, skip=self.skip, hidden=hidden)
        if not persist:
            changed = self._diff(found, self.store.table("files"), force, dirty_paths).orderBy("path", "kind")
            return changed.limit(limit) if limit else changed
        number = self.store.current()["number"] + 1
        context, run = self.spark.sparkContext, Scan(self, number, began)
        context.setJobGroup(self.group, "scan", True)
        try:
            return self._run(run, found, force, dirty_paths)
        except Exception as e:
            status = "cancelled" if self._stop or isinstance(e, Cancelled) else "failed"
            self.last_error = "" if status == "cancelled" else str(e).split("\n")[0]
            context.setLocalProperty("spark.jobGroup.id", None)
            row = self._ended(run, status)
            if status == "failed":
                raise
            return row
        finally:
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)

    def _ended(self, run: Scan, status: str) -> DataFrame:
        """The row of a run that did not complete, under the next number that is free: another scan may have taken the run's own."""
        for _ in range(100):
            try:
                return run.finish(status, self.last_error)
            except OSError:
                run.renumber()
        raise OSError("no version number is free")

    def _run(self, run: Scan, found: DataFrame, force: bool, dirty_paths: list[str] | None) -> DataFrame:
        changed, others = run.list(found, lambda listed: self._diff(listed, run.before("files"), force, dirty_paths))
        parsed, scenes = run.parse(changed)
        unread = others.where("kind = 'error'").select("path") if run.metrics["errors"] else None
        files = run.merge(changed, parsed, unread)
        deleted = files.where("dirty_reason = 'deleted_path'").select("id")
        # tables that nothing touched stay in the folder where they are
        for name, some, make, made in (("scripts_parsed", _SCRIPT_TABLES, run.scripts, parsed), ("scenes_parsed", _SCENE_TABLES, run.scenes, scenes)):
            if run.metrics[name] or run.metrics["entries_deleted"] or any(t not in run.tables for t in some):
                make(files, made, deleted)
        run.timed("resolve_ms")
        return run.finish("completed")

    def check(self) -> None:
        if self._stop:
            raise Cancelled("the scan was cancelled")

    def cancel(self) -> None:
        """End the scan that is under way, if there is one; its run row says so."""
        self._stop = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def scan_status(self, generation: int = 0) -> DataFrame:
        """The row of a run, or of the last one."""
        found = self.store.table("metrics")
        return found.where(F.col("generation") == generation) if generation > 0 else found.orderBy(F.desc("generation")).limit(1)

    scan_metrics = scan_status

    def scan_fast(self, *, limit: int | None = None, **options) -> DataFrame:
        """File rows straight from a scan that writes nothing."""
        return inventory.file_rows(self.scan(persist=False, limit=limit, **options).withColumns({"id": F.lit(0).cast("long"), "parent_id": F.lit(0).cast("long"), "is_deleted": F.lit(False)}))

    def last_scan_results(self) -> dict[str, DataFrame]:
        """The last run's row, and the rows of the files that the last whole scan saw."""
        files = self.store.table("files").where("not is_deleted")
        return {"summary": self.scan_status(), "files": inventory.file_rows(files.orderBy(*inventory.file_order("path")))}

    def benchmark_scan(self, runs: int = 1, **options) -> DataFrame:
        """(run, entries, wall_ms) of scans that write nothing."""
        rows = []
        for i in range(max(runs, 1)):
            began = time.time()
            n = self.scan(persist=False, **options).count()
            rows.append((i + 1, n, int(1000 * (time.time() - began))))
        return self.spark.createDataFrame(rows, "run int, entries long, wall_ms long")

    def parsed_scripts(self, **options) -> DataFrame:
        """The scripts that a scan would parse, parsed; nothing is written."""
        dirty = self.scan(persist=False, **options).where("dirty_reason <> 'clean' and kind = 'file'")
        return scripts.parse_scripts(tree.opened(tree.dealt(dirty.where(F.col("extension").isin(*scripts.LANGUAGES))), self.root))

    def import_inventory(self, found: dict[str, Any]) -> DataFrame:
        """Take another tool's inventory for that of a scan: files, classes, autoloads, and the files of unknown type. Rows that it lacks
        go, known ones keep their ids and first_seen, and of items with one key the last counts. The run's row."""
        run = Scan(self, self.store.current()["number"] + 1, time.time())
        tables = imports.tables(self.spark, found)
        try:
            return self._import(run, tables)
        except Exception as e:
            self.last_error = str(e).split("\n")[0]
            self._ended(run, "failed")
            raise

    def _import(self, run: Scan, tables: dict[str, DataFrame]) -> DataFrame:
        files = imports.last_of(tables["files"].where("path <> ''"), "path")
        known = run.before("files").select("path", "id", F.col("first_seen").alias("_first"))
        top = run.before("files").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        files = files.join(known, "path", "left").withColumns({
            "parent_path": text.parent_path(F.col("path")), "kind": F.when(F.col("is_directory"), "directory").otherwise("file"), "file_identity": F.lit(""),
            "is_hidden": F.col("name").startswith("."), "parse_status": F.lit("not_parsed"), "first_seen": F.coalesce("_first", F.lit(run.number)), "last_seen": F.lit(run.number),
            "is_deleted": F.lit(False), "dirty_reason": F.lit(""), "parent_id": F.lit(0).cast("long"), **{f"{k}_version": F.lit(0) for k in (*VERSIONS, "scene_parser")},
        }).drop("_first")
        files = run.keep("_imported", files)
        files = files.where("id is not null").unionByName(numbered(files.where("id is null").drop("id"), "path", top + 1))
        files = run.keep("files", resolve.parents(files))
        ids = files.select(F.col("path").alias("_at"), F.col("id").alias("target_id"))
        autoloads = imports.last_of(tables["autoloads"].where("autoload_name <> ''"), "autoload_name")
        autoloads = autoloads.join(ids, F.col("target_project_relative_path") == F.col("_at"), "left").drop("_at")
        run.keep("autoloads", merge.prune(run.before("autoloads"), autoloads, "autoload_name", run.number))
        unknown = files.where("file_type = 'Unknown'").select("path", "extension", "name", "file_type", "engine_type")
        run.keep("unknowns", merge.prune(run.before("unknowns"), unknown, ["path", "extension"], run.number))
        # what hung on files that the inventory lacks goes with them
        lost = run.before("files").select("id").join(files.select("id"), "id", "left_anti")
        run.metrics["entries_deleted"] = lost.count()
        for name, owner in BUCKETED.items() if run.metrics["entries_deleted"] else ():
            if name != "classes" and name in run.tables:
                target = _TARGETS.get(name)
                touched = run._buckets(name, lost) | (run._targets(name, lost, target) if target else set())
                run.rewrite(name, touched, _letting_go(lost, owner, target))
        classes = imports.last_of(tables["custom_classes"].where("class_name <> ''"), "class_name")
        classes = classes.join(files.select(F.col("path").alias("script_path"), F.col("id").alias("file_id")), "script_path", "left")
        classes = classes.withColumns({"is_node_type": F.col("base_type").isin(*scripts.NODE_TYPES), "is_resource_type": F.col("base_type").isin(*scripts.RESOURCE_TYPES)})
        run.rewrite("classes", set(range(run.buckets)), lambda old: shaped("classes", classes))
        counts = files.groupBy("is_directory").count().collect()
        run.metrics |= {("dirs_seen" if r[0] else "files_seen"): r[1] for r in counts}
        return run.finish("completed")

    def imported_autoloads(self) -> DataFrame:
        """The autoloads of the last import, with the files that they name."""
        return self.store.table("autoloads").orderBy("autoload_name")

    def unknowns(self) -> DataFrame:
        """The files of the last import whose type is unknown."""
        return self.store.table("unknowns").orderBy("path", "extension")

    # changes

    def watch(self, folder: str, every: str = "1 second", events: DataFrame | None = None) -> None:
        """Gather changes of the tree from now on in a folder that the cluster shares: `events`, or what snapshots of the tree tell. A
        folder that was watched before goes on from there."""
        if events is None:
            events = tree_changes(self.spark, self.root, f"{folder.rstrip('/')}/snapshots", skip=",".join(self.skip))
        self.watcher.start(events, folder, every)

    def scan_changes(self) -> DataFrame:
        """A scan of what the watcher has seen since the last one; of everything if it does not run. A whole scan follows what the watcher
        could not see."""
        if not self.watcher.status()["running"]:
            return self.scan()
        paths = self.watcher.drain()
        return self.scan(dirty_paths=paths or None)

    # files and classes

    def file_count(self, **query) -> int:
        return inventory.filter_files(self.store.table("files"), **query).count()

    def files_page(self, offset: int = 0, limit: int = inventory.PAGE, sort: str = "path", **query) -> DataFrame:
        """A page of the files that meet a query; from a laid order where there is one (see `lay_pages`)."""
        deleted = query.pop("include_deleted", False)  # laid orders are of files that exist
        keep = lambda df: inventory.filter_files(df, include_deleted=deleted, **query)
        found = None if deleted else self._page("files", sort, offset, limit, keep, query)
        return inventory.file_rows(inventory.page(keep(self.store.table("files")), inventory.file_order(sort), offset, limit) if found is None else found)

    def lay_pages(self, *sorts: str) -> None:
        """Lay the files and classes of the current version out in orders (all that are named, or all that there are), so that a page
        at any offset reads its own rows and no list is sorted for it. Orders belong to a table as it is: a scan that writes the table
        anew ends them, and questions then sort again until they are laid again."""
        version = self.store.current()
        listed = {
            "files": (self.store.table("files", version).where("not is_deleted"), inventory.file_order),
            "classes": (self._classes(version), inventory.class_order),
        }
        for name, (rows_of, order) in listed.items():
            for sort in SORTS[name]:
                place = self.store.beside(name, sort, version)
                if place and (not sorts or sort in sorts) and not self.store.holds(f"{place}/counts"):
                    made = f"{place}-{uuid.uuid4().hex[:8]}"
                    pages.lay(rows_of, order(sort), made)
                    self.store.put(made, place)

    def _page(self, name: str, sort: str, offset: int, limit: int, keep: Callable[[DataFrame], DataFrame], query: dict[str, Any]) -> DataFrame | None:
        """A page of a laid order; None where there is none, or where a pass that keeps the first rows is the better way."""
        filtered = any(v is not None and v != "" for v in query.values())
        if filtered and offset + limit <= NEAR:
            return None
        at = self.store.beside(name, sort if sort in SORTS[name] else SORTS[name][0])
        return pages.page(self.spark, at, offset, limit, keep if filtered else None) if at and self.store.holds(f"{at}/counts") else None

    def _classes(self, version: dict | None = None) -> DataFrame:
        return self.store.table("classes", version).withColumn("id", F.col("file_id"))

    def file_details(self, file_id: int) -> DataFrame:
        return inventory.file_rows(self.store.table("files").where(F.col("id") == file_id if file_id > 0 else F.lit(False)))

    def directory_children(self, directory_id: int) -> DataFrame:
        return self.files_page(parent_id=directory_id)

    def class_count(self, **query) -> int:
        return inventory.filter_classes(self.store.table("classes"), **query).count()

    def classes_page(self, offset: int = 0, limit: int = inventory.PAGE, sort: str = "class_name", **query) -> DataFrame:
        keep = lambda df: inventory.filter_classes(df, **query)
        found = self._page("classes", sort, offset, limit, keep, query)
        return inventory.page(keep(self._classes()), inventory.class_order(sort), offset, limit) if found is None else found

    def class_details(self, class_name: str) -> DataFrame:
        return self.store.table("classes").where((F.col("class_name") == class_name) & (F.lit(class_name) != ""))

    def export_inventory(self) -> dict[str, Any]:
        """Files and classes whole and in order, and how many there are; written by one sort each instead of pages."""
        files = inventory.file_rows(self.store.table("files").orderBy(*inventory.file_order("path")))
        classes = self._classes().orderBy(*inventory.class_order("class_name"))
        return {"files": files, "custom_classes": classes, "file_count": files.count(), "custom_class_count": classes.count()}

    def autoloads(self) -> DataFrame:
        found = scripts.parse_project_files(tree.tree(self.spark, self.root).where("path = 'project.godot'")).select(F.explode("autoloads").alias("a")).select("a.*")
        ids = self.store.table("files").where("not is_deleted").select(F.col("path").alias("target_project_relative_path"), F.col("id").alias("target_id"))
        return found.join(ids, "target_project_relative_path", "left")

    # graph

    def _edges(self) -> DataFrame:
        return self.store.table("dependencies").withColumnsRenamed({"file_id": "src", "target_id": "dst"})

    def _dependencies(self, found: DataFrame, *first: str) -> DataFrame:
        return rows.edge_rows(found).orderBy(*first, "line", "column", "kind", "reference_text")

    def dependencies_for_script(self, file_id: int) -> DataFrame:
        return self._dependencies(graph.dependencies_of(self._edges(), file_id))

    def dependents_of_file(self, file_id: int) -> DataFrame:
        return self._dependencies(graph.dependents_of(self._edges(), file_id), "src")

    def dependents_of_class(self, class_name: str) -> DataFrame:
        return self._dependencies(self._edges().where((F.col("target_class") == class_name) & (F.lit(class_name) != "")), "src")

    def unresolved_dependencies(self) -> DataFrame:
        return self._dependencies(self._edges().where("is_unresolved"), "src")

    def dynamic_dependencies(self) -> DataFrame:
        return self._dependencies(self._edges().where("is_dynamic"), "src")

    def dependency_cycles(self) -> DataFrame:
        return graph.cycles(self._edges())

    def graph_slice(self, root_id: int, depth: int) -> DataFrame:
        return self._dependencies(graph.slice_from(self._edges(), root_id, depth), "src")

    # symbols and references

    def symbols_for_script(self, file_id: int, **query) -> DataFrame:
        found = inventory.filter_symbols(self.store.table("symbols"), file_id=file_id, over=SYMBOL_SEARCH, **query)
        return rows.symbol_rows(inventory.ordered(found, *resolve.PLACE))

    def functions_for_script(self, file_id: int) -> DataFrame:
        return self.symbols_for_script(file_id, kind="function")

    def properties_for_script(self, file_id: int) -> DataFrame:
        return self.symbols_for_script(file_id, kind="property")

    def parameters_for_function(self, symbol_id: int) -> DataFrame:
        return rows.symbol_rows(resolve.parameters(self.store.table("symbols"), symbol_id).orderBy("slot", "id"))

    def symbol_details(self, symbol_id: int) -> DataFrame:
        return rows.symbol_rows(self.store.table("symbols").where(F.col("id") == symbol_id))

    def doc_comment_gaps(self, **query) -> DataFrame:
        """Symbols without an attached doc comment; a search also looks at the path of their file."""
        paths = self.store.table("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
        symbols = self.store.table("symbols").join(paths, "file_id", "left")
        found = inventory.filter_symbols(symbols, over=(*SYMBOL_SEARCH, "file_path"), **query)
        return rows.symbol_rows(resolve.doc_gaps(found, self.store.table("doc_comments")).orderBy("file_id", "line", "column", "id"))

    def references(self, file_id: int = 0, kind: str = "") -> DataFrame:
        return self._references(file_id, kind)

    def _references(self, file_id: int = 0, kind: str = "", where: str = "true") -> DataFrame:
        refs = self.store.table("references").where(where)
        refs = refs.where(F.col("file_id") == file_id) if file_id > 0 else refs
        refs = refs.where(F.col("kind") == kind) if kind else refs
        return rows.edge_rows(refs).orderBy("file_id", "line", "column", "kind", "reference_text")

    def references_from_symbol(self, symbol_id: int) -> DataFrame:
        return rows.edge_rows(self.store.table("references").where(F.col("source_symbol_id") == symbol_id)).orderBy("line", "column", "kind", "reference_text")

    def unresolved_references(self, file_id: int = 0, kind: str = "") -> DataFrame:
        return self._references(file_id, kind, "is_unresolved")

    def dynamic_references(self, file_id: int = 0, kind: str = "") -> DataFrame:
        return self._references(file_id, kind, "is_dynamic")

    def script_summary(self, file_id: int) -> DataFrame:
        return summary.script_summary(file_id, self.store.table("symbols"), self.store.table("doc_comments"), self.store.table("references"))

    # scenes

    def attachments(self, scene_id: int = 0, script_id: int = 0) -> DataFrame:
        found = self.store.table("attachments")
        found = found.where(F.col("scene_id") == scene_id) if scene_id > 0 else found
        found = found.where(F.col("script_id") == script_id) if script_id > 0 else found
        return rows.attachment_rows(found).orderBy("scene_id", "line", "node_path", "resource_id")

    def scenes_using_script(self, script_id: int) -> DataFrame:
        return self.attachments(script_id=script_id) if script_id > 0 else self.attachments().limit(0)

    def scripts_of_scene(self, scene_id: int) -> DataFrame:
        return self.attachments(scene_id=scene_id) if scene_id > 0 else self.attachments().limit(0)

    def summary(self) -> DataFrame:
        count = lambda name: self.store.table(name).agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
        latest = self.scan_status().withColumn("_one", F.lit(1))
        return count("files").join(count("classes"), "_one").join(count("symbols"), "_one").join(latest, "_one", "left").drop("_one")
