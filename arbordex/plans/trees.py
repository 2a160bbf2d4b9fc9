"""Queries that scan a tree of files: it is written from the driver's tables, and the SQL says from the same tables what a scan must find.

Each supplier is a script in the folder of its nation, and each nation with suppliers has a scene that uses its first script. Scripts
name the class of the next supplier, whose file may lack.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.operators.lineage import checkpoint_folder
from arbordex.project import Project
from arbordex.sources import sql, tree

_GD = (
    "concat('class_name S', s_suppkey, '\\nextends Node3D\\n', CASE WHEN s_suppkey % 2 = 0 THEN '## Doc.\\n' ELSE '' END, 'func go(a: int) -> S', "
    "s_suppkey + 1, ':\\n\\tpass\\nvar next: S', s_suppkey + 1, ' = null\\nvar home = preload(\"res://n', s_nationkey, '/main.tscn\")\\n\\tload(next)\\n')"
)
_CS = (
    "concat('[GlobalClass]\\npublic partial class S', s_suppkey, ' : Node3D {\\n  void F() { var s = GD.Load<S', s_suppkey + 1, "
    "'>(\"res://n', s_nationkey, '/main.tscn\"); }\\n}\\n')"
)
_SCENE = (
    "concat('[ext_resource type=\"Script\" path=\"res://', first.path, '\" uid=\"uid://u', first.s_suppkey, '\" id=\"1\"]\\n[node name=\"Top\" type=\"Node3D\"]\\n"
    "script = ExtResource(\"1\")\\n[node name=\"Low\" parent=\".\"]\\nscript = made()\\n')"
)
PATH = "concat('n', CAST(s_nationkey AS STRING), '/s', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 5 = 0 THEN '.cs' ELSE '.gd' END)"
#: The files as rows, for all SQL below.
SCRIPTS = f"""s AS (SELECT s_suppkey AS k, concat('n', CAST(s_nationkey AS VARCHAR)) AS folder, {PATH.replace('STRING', 'VARCHAR')} AS path, s_suppkey % 5 = 0 AS sharp,
  s_suppkey = max(s_suppkey) OVER () AS last FROM supplier), scenes AS (SELECT folder, concat(folder, '/main.tscn') AS path, min(k) AS k FROM s GROUP BY folder)"""


def write_tree(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a new tree; the tasks write its files, so all of them must reach the folder."""
    root = f"{checkpoint_folder(spark).removeprefix('file://').rstrip('/')}/tree-{uuid.uuid4().hex}"
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", "s_nationkey", f"{PATH} AS path")
    files = supplier.selectExpr("path", f"CASE WHEN s_suppkey % 5 = 0 THEN {_CS} ELSE {_GD} END AS content")
    scenes = supplier.groupBy("s_nationkey").agg(F.min(F.struct("s_suppkey", "path")).alias("first"))
    files = files.unionByName(scenes.selectExpr("concat('n', s_nationkey, '/main.tscn') AS path", f"{_SCENE} AS content"))

    def save(rows) -> None:
        for r in rows:
            at = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(r["content"])

    # a few small tables are read by one task; their files are the work
    tree.dealt(files).foreachPartition(save)
    return root


_written: dict[tuple[str, str], str] = {}
_scanned: dict[tuple[str, str], Project] = {}


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the tables' tree; one for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = write_tree(spark, sf_dir)
    return _written[key]


def scanned(spark: SparkSession, sf_dir: str) -> Project:
    """A project of the tables' tree after its first scan; one for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scanned:
        root = written(spark, sf_dir)
        project = Project(spark, root, f"{root}-store")
        project.scan()
        _scanned[key] = project
    return _scanned[key]


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scanned(spark, sf_dir).store.table("files")
    parents = files.select(F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return files.join(parents, "parent_id", "left").select("path", "kind", "file_type", "engine_type", "parse_status", F.coalesce("parent", F.lit("")).alias("parent"))


def project_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).store.table("classes").select("class_name", "script_path", "language", "base_type", "is_node_type")


def project_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the paths and names of what they were bound to."""
    project = scanned(spark, sf_dir)
    paths = project.store.table("files").select("id", F.col("path").alias("at"))
    names = project.store.table("symbols").select("id", F.col("name").alias("named"), F.col("kind").alias("symbol_kind"))
    found = project.references()
    found = found.join(paths.withColumnsRenamed({"id": "file_id", "at": "path"}), "file_id")
    found = found.join(paths.withColumnsRenamed({"id": "target_id", "at": "bound_path"}), "target_id", "left")
    found = found.join(names.withColumnsRenamed({"id": "target_symbol_id", "named": "bound_symbol"}).drop("symbol_kind"), "target_symbol_id", "left")
    found = found.join(names.withColumnsRenamed({"id": "source_symbol_id", "named": "source", "symbol_kind": "source_kind"}), "source_symbol_id", "left")
    return found.select("path", "kind", "line", "target_class", "target_path", "bound_path", "bound_symbol", "source", "is_resolved", "is_dynamic", "is_unresolved")


def project_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = scanned(spark, sf_dir)
    paths = project.store.table("files").select("id", F.col("path").alias("at"))
    names = project.store.table("symbols").select(F.col("id").alias("script_symbol_id"), F.col("name").alias("bound_symbol"))
    found = project.attachments().join(paths.withColumnsRenamed({"id": "scene_id", "at": "scene"}), "scene_id")
    found = found.join(paths.withColumnsRenamed({"id": "script_id", "at": "bound_path"}), "script_id", "left").join(names, "script_symbol_id", "left")
    return found.select("scene", "node_path", "script_path", "resource_uid", "bound_path", "bound_symbol", "is_dynamic", "is_resolved")


def project_doc_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).doc_comment_gaps(kind="function").where("language = 'GDScript'").select("file_path", "name")


def project_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a scan after scripts went, changed and came: keys that end in 3, in 4, and a new one in each folder."""
    root = write_tree(spark, sf_dir)
    project = Project(spark, root, f"{root}-store")
    project.scan()

    def change(rows) -> None:
        for r in rows:
            f = os.path.join(root, r["path"])
            stem = os.path.basename(f).split(".")[0]
            if stem.endswith("3"):
                if os.path.exists(f):  # a task may run again
                    os.remove(f)
            elif stem.endswith("4"):
                with open(f, "a", encoding="utf-8") as out:
                    out.write("# more\n")
            elif stem == "main":
                with open(os.path.join(os.path.dirname(f), "fresh.gd"), "w", encoding="utf-8") as out:
                    out.write("class_name Fresh\n")

    # the scan has listed the tree, so the tasks change a list of files that stays as it is
    files = project.store.table("files").where("kind = 'file'").select("path")
    tree.dealt(files).foreachPartition(change)
    return project.scan().select("status", "files_seen", "dirs_seen", "inserted", "updated", "refreshed", "entries_deleted", "scripts_parsed", "scenes_parsed")


def project_symbols_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the tree's scripts, asked in SQL of the tree source itself, which needs no scan."""
    sql.register(spark)
    tree.tree(spark, written(spark, sf_dir)).createOrReplaceTempView("project_tree_files")
    return spark.sql(
        "SELECT f.path, file_type_of(f.path) AS file_type, s.name, s.class_name, s.return_type FROM project_tree_files f, LATERAL script_symbols(f.path, f.content) s "
        "WHERE f.extension IN ('.gd', '.cs') AND s.symbol_kind = 'function'"
    )


def document_symbols_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts made of documents, each text a comment above a function; their symbols, asked in SQL."""
    sql.register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("sql_documents")
    script = "concat('# ', replace(text, '\\n', ' '), '\\nfunc f', doc_id, '(n: int) -> void:\\n\\tpass\\nvar size := ', n_chars, '\\n')"
    return spark.sql(
        f"SELECT d.doc_id, s.symbol_kind, s.name, s.declared_type, s.return_type, s.doc_comment_state, s.line_start FROM (SELECT doc_id, {script} AS source FROM sql_documents) d, "
        "LATERAL script_symbols('document.gd', d.source) s"
    )


_EDGES = """SELECT path, 'class_name_declaration' AS kind, CASE WHEN sharp THEN 2 ELSE 1 END AS line, concat('S', k) AS target_class, '' AS target_path, path AS bound_path, concat('S', k) AS bound_symbol, concat('S', k) AS source, true AS is_resolved, false AS is_dynamic, false AS is_unresolved FROM s
  UNION ALL SELECT path, 'extends_class', 2, 'Node3D', '', NULL, NULL, concat('S', k), false, false, true FROM s
  UNION ALL SELECT path, 'typed_return_ref', CASE WHEN sharp THEN 3 WHEN k % 2 = 0 THEN 4 ELSE 3 END, concat('S', k + 1), '', next, CASE WHEN NOT last THEN concat('S', k + 1) END, CASE WHEN sharp THEN 'F' ELSE 'go' END, NOT last, false, last FROM s
  UNION ALL SELECT path, 'typed_var_ref', CASE WHEN k % 2 = 0 THEN 6 ELSE 5 END, concat('S', k + 1), '', next, CASE WHEN NOT last THEN concat('S', k + 1) END, 'next', NOT last, false, last FROM s WHERE NOT sharp
  UNION ALL SELECT path, 'preload_path', CASE WHEN k % 2 = 0 THEN 7 ELSE 6 END, '', concat('res://', folder, '/main.tscn'), concat(folder, '/main.tscn'), NULL, 'home', true, false, false FROM s WHERE NOT sharp
  UNION ALL SELECT path, 'gd_load_path', 3, '', concat('res://', folder, '/main.tscn'), concat(folder, '/main.tscn'), NULL, 'F', true, false, false FROM s WHERE sharp
  UNION ALL SELECT path, 'dynamic_load', CASE WHEN k % 2 = 0 THEN 8 ELSE 7 END, '', '', NULL, NULL, 'home', false, true, false FROM s WHERE NOT sharp"""

QUERIES = {f.__name__: f for f in (project_files, project_classes, project_references, project_attachments, project_doc_gaps, project_rescan, project_symbols_sql, document_symbols_sql)}
ORACLE = {
    "project_files": f"""WITH {SCRIPTS} SELECT path, 'file' AS kind, 'Script' AS file_type, CASE WHEN sharp THEN 'CSharpScript' ELSE 'GDScript' END AS engine_type, 'parsed_class' AS parse_status, folder AS parent FROM s
      UNION ALL SELECT path, 'file', 'GodotScene', 'PackedScene', 'not_parsed', folder FROM scenes UNION ALL SELECT folder, 'directory', 'Folder', 'NGT', 'not_parsed', '' FROM scenes""",
    "project_classes": f"WITH {SCRIPTS} SELECT concat('S', k) AS class_name, path AS script_path, CASE WHEN sharp THEN 'CSharp' ELSE 'GDScript' END AS language, 'Node3D' AS base_type, true AS is_node_type FROM s",
    "project_references": f"WITH {SCRIPTS.replace('s AS', 'r AS', 1).replace('FROM s GROUP', 'FROM r GROUP')}, s AS (SELECT r.*, n.path AS next FROM r LEFT JOIN r n ON n.k = r.k + 1) {_EDGES}",
    "project_attachments": f"""WITH {SCRIPTS} SELECT scenes.path AS scene, 'Top' AS node_path, concat('res://', s.path) AS script_path, concat('uid://u', s.k) AS resource_uid, s.path AS bound_path, concat('S', s.k) AS bound_symbol, false AS is_dynamic, true AS is_resolved
      FROM scenes JOIN s USING (k) UNION ALL SELECT path, 'Low', '', '', NULL, NULL, true, false FROM scenes""",
    "project_symbols_sql": f"WITH {SCRIPTS} SELECT path, 'Script' AS file_type, CASE WHEN sharp THEN 'F' ELSE 'go' END AS name, concat('S', k) AS class_name, CASE WHEN sharp THEN '' ELSE concat('S', k + 1) END AS return_type FROM s",
    "document_symbols_sql": """SELECT doc_id, 'function' AS symbol_kind, concat('f', doc_id) AS name, '' AS declared_type, 'void' AS return_type, 'detached' AS doc_comment_state, 2 AS line_start FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'parameter', 'n', 'int', '', 'missing', 2 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'property', 'size', '', '', 'missing', 4 FROM documents WHERE text IS NOT NULL""",
    "project_doc_gaps": f"WITH {SCRIPTS} SELECT path AS file_path, 'go' AS name FROM s WHERE NOT sharp AND k % 2 = 1",
    "project_rescan": f"""WITH {SCRIPTS}, n AS (SELECT count(*) AS scripts, count(*) FILTER (k % 10 = 3) AS gone, count(*) FILTER (k % 10 = 4) AS changed, count(DISTINCT folder) AS folders FROM s)
      SELECT 'completed' AS status, scripts - gone + 2 * folders AS files_seen, folders AS dirs_seen, folders AS inserted, changed AS updated, scripts - gone - changed + 2 * folders AS refreshed, gone AS entries_deleted, changed + folders AS scripts_parsed, 0 AS scenes_parsed FROM n""",
}
