"""Generations of tables on any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_EDGE = (
    "reference_text string, confidence_milli int, is_dynamic boolean, line long, `column` long, slot long, target_path string, "
    "target_class string, target_name string, target_uid string, target_id long, target_symbol_id long, source_symbol_id long, "
    "is_resolved boolean, is_unresolved boolean"
)
_COUNTS = (
    "files_seen dirs_seen dirs_skipped errors entries_clean entries_dirty entries_new entries_deleted inserted updated refreshed "
    "scripts_candidates scripts_parsed scripts_skipped_clean scenes_parsed scenes_skipped_clean lines_scanned bytes_read "
    "tokens_generated limit_exceeded symbols_created references_created doc_comments_created attachments_created "
    "dependencies_created unresolved_dependencies dynamic_dependencies snapshot_entries buckets_written"
).split()
_TIMES = "traversal_ms parse_ms merge_ms resolve_ms wall_ms".split()
SCHEMAS = {
    "files": (
        "path string, parent_path string, name string, kind string, size_bytes long, modified_ns long, file_identity string, "
        "is_hidden boolean, extension string, file_type string, engine_type string, is_directory boolean, parse_status string, "
        "parser_version int, dependency_parser_version int, scene_parser_version int, classifier_version int, first_seen long, "
        "last_seen long, is_deleted boolean, dirty_reason string, id long, parent_id long"
    ),
    "symbols": (
        "id long, file_id long, slot long, parent_id long, parent_slot long, kind string, name string, qualified_name string, "
        "symbol_name string, class_name string, language string, declared_type string, return_type string, default_value string, "
        "signature string, doc_state string, flags long, line long, `column` long"
    ),
    "dependencies": f"file_id long, kind string, {_EDGE}",
    "references": f"file_id long, kind string, {_EDGE}",
    "doc_comments": (
        "file_id long, symbol_id long, is_attached boolean, style string, comment_text string, summary_text string, "
        "text_hash string, line long"
    ),
    "classes": (
        "class_name string, script_path string, file_id long, language string, base_type string, is_node_type boolean, "
        "is_resource_type boolean"
    ),
    "resources": (
        "scene_id long, resource_id string, slot long, type string, path string, uid string, target_id long, is_resolved boolean"
    ),
    "attachments": (
        "scene_id long, node_path string, node_name string, node_type string, resource_id string, attachment_kind string, "
        "script_path string, script_uid string, script_id long, script_symbol_id long, is_dynamic boolean, is_resolved boolean, "
        "is_unresolved boolean, line long"
    ),
    "deleted_log": "path string, generation long",
    "autoloads": (
        "autoload_name string, target_path string, target_project_relative_path string, is_singleton boolean, target_id long, "
        "first_seen long, last_seen long"
    ),
    "unknowns": "path string, extension string, name string, file_type string, engine_type string, first_seen long, last_seen long",
    "metrics": f"generation long, status string, error string, {', '.join(f'{c} long' for c in [*_COUNTS, *_TIMES])}",
}
METRICS = [*_COUNTS, *_TIMES]
#: Tables in buckets, by what their rows are dealt: a scan writes only the buckets that it changes.
BUCKETED = {"symbols": "file_id", "dependencies": "file_id", "references": "file_id", "doc_comments": "file_id", "resources": "scene_id", "attachments": "scene_id", "classes": "class_name"}
#: Buckets of a new store. A bucket is what one changed script rewrites of a table, so large projects take more.
BUCKETS = 16


def bucket(name: str, buckets: int, key: Column | None = None) -> Column:
    """The bucket of a row of a table, or of a key."""
    key = F.col(BUCKETED[name]) if key is None else key
    return F.pmod(F.xxhash64(key) if BUCKETED[name] == "class_name" else key, F.lit(buckets)).cast("int")


def shaped(name: str, df: DataFrame) -> DataFrame:
    """df with the columns and types of a table."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name])])


class Store:
    """Tables in one folder. A version file names the folder of each table, or of each bucket of a table; the highest number is the
    current version.

    A version is written under another name and renamed to a number that must be free, so readers see whole versions, a crash leaves
    the last one in place, and of two writers of one number the second fails. Tables that a version did not change stay where they are.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.new_buckets = spark, folder.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        at = self._path(f"{self.folder}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit())

    def current(self) -> dict:
        """{"number": 0 if there is none, "tables": {name: folder}}."""
        found = self._versions()
        if not found:
            return {"number": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{found[-1]}", wholetext=True).first()[0])

    def buckets(self, version: dict) -> int:
        """How many buckets the tables of a store have: those of its first version."""
        return version.get("buckets", self.new_buckets)

    def table(self, name: str, version: dict | None = None, only: set[int] | None = None) -> DataFrame:
        """A table of a version; of a table in buckets all of them or `only` some."""
        at = (version or self.current())["tables"].get(name)
        some = [at] if isinstance(at, str) else [f for k, f in (at or {}).items() if only is None or int(k) in only]
        if not some:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{f}" for f in some])

    def beside(self, name: str, label: str, version: dict | None = None) -> str | None:
        """The folder for what is made of a table as a version has it: named by what the table is made of, and gone when its newest
        part goes. None where the version has no such table."""
        at = (version or self.current())["tables"].get(name)
        parts = [at] if isinstance(at, str) else list((at or {}).values())
        if not parts:
            return None
        newest = max((f.split("/")[0] for f in parts), key=lambda f: int(f[1:].split("-")[0]))
        made_of = hashlib.sha256(json.dumps(at, sort_keys=True).encode()).hexdigest()[:16]
        return f"{self.folder}/{newest}/{name}-{label}-{made_of}"

    def holds(self, folder: str) -> bool:
        """Whether a folder was written to its end."""
        return self._fs.exists(self._path(f"{folder}/_SUCCESS"))

    def put(self, made: str, place: str) -> None:
        """Move a folder to a place; what another writer has put there stays."""
        if self._fs.exists(self._path(place)) or not self._fs.rename(self._path(made), self._path(place)):
            self._fs.delete(self._path(made), True)

    def write_buckets(self, folder: str, name: str, df: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows of some buckets; where each bucket that has rows is."""
        dealt = df.withColumn("_bucket", bucket(name, buckets)).repartition(F.col("_bucket"))
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{folder}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{folder}/{name}"))]
        return {n.split("=")[1]: f"{folder}/{name}/{n}" for n in sorted(found) if n.startswith("_bucket=")}

    def write(self, folder: str, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{folder}/{name}")

    def publish(self, number: int, tables: dict[str, str | dict[str, str]], keep: int = 2, buckets: int | None = None) -> None:
        """Make `tables` version `number`; what only versions before the last `keep` use is removed."""
        name = f"{number:012}"
        fresh = self._path(f"{self.folder}/versions/.{name}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"number": number, "tables": tables, "buckets": buckets or self.new_buckets}).encode()))
        out.close()
        place = self._path(f"{self.folder}/versions/{name}")
        if self._fs.exists(place) or not self._fs.rename(fresh, place):
            raise OSError(f"version {number} is there already")
        self._clear(keep)

    def _clear(self, keep: int) -> None:
        versions = self._versions()
        for old in versions[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{old}"), False)
        used = set()
        for v in versions[-keep:]:
            text = self.spark.read.text(f"{self.folder}/versions/{v}", wholetext=True).first()[0]
            used |= {f.split("/")[0] for at in json.loads(text)["tables"].values() for f in ([at] if isinstance(at, str) else at.values())}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            # a folder of the version being written has a higher number than all published ones
            if name.startswith("g") and name not in used and int(name[1:].split("-")[0]) < int(versions[-1]):
                self._fs.delete(s.getPath(), True)
