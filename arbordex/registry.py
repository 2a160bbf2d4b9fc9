"""The projects that are known, and the identity of a project on disk."""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.operators import merge

PROJECTS = (
    "id long, uid string, root string, project_file string, display_name string, identity_source string, identity_warning string, "
    "first_seen long, last_seen long"
)
#: Lists of projects fall by these.
ORDER = ("last_seen", "id")
#: Where a project keeps its identity.
UID_FILE = ".godot/arbordex/project.uid"


def seeded_uid(prefix: str, *parts: str) -> str:
    return prefix + hashlib.sha256("|".join(parts).encode()).hexdigest()[:40]


def identity(root: str, project_file: str = "project.godot", uid_file: str = UID_FILE) -> tuple[str, str, str]:
    """(uid, source, warning): the first line of the uid file; else a new one that is written there; else one derived from the paths."""
    at, file = os.path.join(root, uid_file), os.path.join(root, project_file)
    try:
        with open(at, encoding="utf-8", errors="replace") as f:
            if uid := f.readline().strip(" \t\r\n"):
                return uid, "uid_file", ""
    except OSError:
        pass
    made = seeded_uid("arbordex-", root, file, str(int(time.time())))
    try:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(made + "\n")
        return made, "uid_file", ""
    except OSError as e:
        return seeded_uid("path-derived-", root, file), "path_derived", f"the project's uid could not be kept at {at}: {e.strerror}"


class Registry:
    """Known projects as versions of one Parquet table."""

    def __init__(self, spark: SparkSession, folder: str):
        from arbordex.store import Store

        self.spark, self.store, self.last_error = spark, Store(spark, folder), ""

    def projects(self) -> DataFrame:
        """All projects, those seen last first, with whether their identity comes from their paths."""
        at = self.store.current()["tables"].get("projects")
        found = self.spark.read.schema(PROJECTS).parquet(f"{self.store.folder}/{at}") if at else self.spark.createDataFrame([], PROJECTS)
        return found.withColumn("is_path_derived_identity", F.col("identity_source") == "path_derived").orderBy(*ORDER, ascending=False)

    def project(self, project_id: int) -> DataFrame:
        found = self.projects()
        return found.where(F.col("id") == project_id) if project_id > 0 else found.limit(0)

    def register(self, root: str, name: str = "", project_file: str = "project.godot", uid_file: str = UID_FILE) -> int:
        """Add the project at root or bring it up to date; its id. A conflict raises ValueError and changes nothing."""
        root = os.path.realpath(root)
        uid, source, warning = identity(root, project_file, uid_file)
        known, now = self.projects().drop("is_path_derived_identity"), int(time.time())
        wanted = self.spark.createDataFrame([(uid, root)], "uid string, root string")
        decided = merge.register(known.select("id", "uid", "root"), wanted).first()
        if decided["action"].startswith("error"):
            self.last_error = decided["action"]
            raise ValueError(decided["action"])
        version = self.store.current()
        if decided["action"] == "insert":
            project, first = (known.agg(F.max("id")).first()[0] or 0) + 1, now
        else:
            project = decided["project_id"]
            first = known.where(F.col("id") == project).first()["first_seen"]
        row = (project, uid, root, os.path.join(root, project_file), name or os.path.basename(root), source, warning, first, now)
        table = known.where(F.col("id") != project).unionByName(self.spark.createDataFrame([row], PROJECTS))
        self.replace(table, version["number"] + 1)
        return project

    def replace(self, projects: DataFrame, number: int | None = None) -> None:
        """Make `projects` (PROJECTS) the known ones, as version `number` or the next."""
        number = number or self.store.current()["number"] + 1
        folder = f"g{number}-{uuid.uuid4().hex[:16]}"
        self.store.write(folder, "projects", projects)
        self.store.publish(number, {"projects": f"{folder}/projects"})
