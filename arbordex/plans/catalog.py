"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.functions import classify, taxonomy, text
from arbordex.operators import graph, inventory, merge, pages, resolve, snapshot, summary

from arbordex.plans import trees
from arbordex.plans.adapters import frame, with_sql
from arbordex.sources import scripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FOLD = f"translate({{}}, '{text.UPPER}', '{text.LOWER}')".format
LIKE = (lambda column, pattern: f"{FOLD(column)} LIKE {FOLD(repr(pattern))}")
NAMES = ["name", "symbol_name", "class_name"]
VERSIONS = {"parser": 2, "dependency_parser": 1, "classifier": 2}


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its SQL over the adapters."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_sql(" ".join(sql.split()))
        return f

    return add


def typed_files(spark: SparkSession, sf_dir: str, parents: bool = True) -> DataFrame:
    """The files with file type, resource type and, where it is asked for, parent id, which takes a join."""
    files = frame(spark, sf_dir, "files")
    files = files.withColumn("file_type", classify.file_type(F.col("path"), F.col("is_directory"))).withColumn("engine_type", classify.type_hint(F.col("path"), F.col("is_directory")))
    return resolve.parents(files.withColumn("parent_id", F.lit(0).cast("long"))) if parents else files


EXTENSION = f"CASE WHEN regexp_matches({FOLD('name')}, '^.+\\.[^.]+$') THEN regexp_extract({FOLD('name')}, '^.+(\\.[^.]+)$', 1) ELSE '' END"
# written out by hand, apart from the tables under test: patterns over the folded name
TYPE = """CASE WHEN is_directory THEN 'Folder'
  WHEN regexp_matches(extension, '^\\.(tscn|scn)$') THEN 'GodotScene' WHEN regexp_matches(extension, '^\\.(tres|res|meshlib)$') THEN 'GodotResource'
  WHEN regexp_matches(extension, '^\\.(gd|cs|sh)$') THEN 'Script' WHEN regexp_matches(extension, '^\\.(gdshader(inc)?|shader)$') THEN 'Shader'
  WHEN extension = '.import' THEN 'GodotImportMetadata' WHEN regexp_matches(extension, '^\\.(node|object|resource)$') THEN 'GodotEditorMetadata'
  WHEN regexp_matches(extension, '^\\.(json|csv|ya?ml|toml|xml|dat|bytes)$') THEN 'Data' WHEN regexp_matches(extension, '^\\.(png|jpe?g|webp|svg|bmp|gif|tga)$') THEN 'Asset'
  WHEN extension = '.exr' THEN 'Image' WHEN regexp_matches(extension, '^\\.(wav|mp3|ogg|opus|flac)$') THEN 'Audio' WHEN regexp_matches(extension, '^\\.(otf|ttf|fnt|woff2?)$') THEN 'Font'
  WHEN regexp_matches(extension, '^\\.blend[12]$') THEN 'ModelBackup' WHEN extension = '.assbin' THEN 'ModelCache' WHEN regexp_matches(extension, '^\\.(glb|gltf|fbx|obj|dae|blend)$') THEN 'Model'
  WHEN regexp_matches(extension, '^\\.(zip|7z|rar|tar|gz)$') THEN 'Archive' WHEN regexp_matches(extension, '^\\.(db|sqlite3?)$') THEN 'Database'
  WHEN regexp_matches(extension, '^\\.(dll|so|dylib|lib|a|o|pdb|exp)$') THEN 'BuildArtifact' WHEN regexp_matches(extension, '^\\.(txt|md|rst|adoc)$') THEN 'Documentation'
  WHEN extension = '.ase' THEN 'ColorPalette' WHEN regexp_matches(extension, '^\\.(c|h|cpp|hpp|py|js|ts|rs|go|java)$') THEN 'SourceCode'
  WHEN regexp_matches(extension, '^\\.(xcf|psd|aseprite|kra)$') THEN 'SourceArt' WHEN extension = '.spp' THEN 'MaterialSource' WHEN extension = '.bin' THEN 'BinaryData'
  WHEN regexp_matches(extension, '^\\.(cfg|ini|conf|config|godot|uid|gdextension)$') THEN 'Config' WHEN extension = '.x86_64' THEN 'GeneratedArtifact' ELSE 'Unknown' END"""
HINT = """CASE WHEN is_directory THEN 'NGT'
  WHEN regexp_matches(extension, '^\\.(tscn|scn|glb|gltf|fbx|dae|blend)$') THEN 'PackedScene' WHEN regexp_matches(extension, '^\\.(tres|res)$') THEN 'Resource'
  WHEN extension = '.meshlib' THEN 'MeshLibrary' WHEN extension = '.gd' THEN 'GDScript' WHEN extension = '.cs' THEN 'CSharpScript'
  WHEN regexp_matches(extension, '^\\.(gd)?shader$') THEN 'Shader' WHEN extension = '.gdshaderinc' THEN 'ShaderInclude'
  WHEN regexp_matches(extension, '^\\.(png|jpe?g|webp|svg|bmp|gif|tga)$') THEN 'Texture2D' WHEN extension = '.wav' THEN 'AudioStreamWAV' WHEN extension = '.mp3' THEN 'AudioStreamMP3'
  WHEN regexp_matches(extension, '^\\.(ogg|opus)$') THEN 'AudioStreamOggVorbis' WHEN regexp_matches(extension, '^\\.(otf|ttf|fnt|woff2?)$') THEN 'FontFile'
  WHEN extension = '.gdextension' THEN 'GDExtension' WHEN extension = '.uid' THEN 'ResourceUID' WHEN regexp_matches(extension, '^\\.(cfg|ini|conf|config|remap)$') THEN 'ConfigFile' ELSE 'NGT' END"""
LABEL = """CASE WHEN is_directory THEN 'Folder'
  WHEN regexp_matches(extension, '^\\.(meshlib|blend|tres|res)$') THEN 'GodotResource' WHEN regexp_matches(extension, '^\\.(tscn|scn)$') THEN 'GodotScene'
  WHEN regexp_matches(extension, '^\\.(gd|cs|sh)$') THEN 'Script' WHEN regexp_matches(extension, '^\\.gdshader(inc)?$') THEN 'Shader'
  WHEN regexp_matches(extension, '^\\.(png|jpe?g|webp|svg|wav|mp3|ogg)$') THEN 'Asset' WHEN extension = '.import' THEN 'GodotImportMetadata' WHEN extension = '.godot' THEN 'Config'
  WHEN regexp_matches(extension, '^\\.(pck|json|csv)$') THEN 'Data' WHEN extension = '.x86_64' THEN 'GeneratedArtifact' WHEN extension = '.xcf' THEN 'SourceArt' WHEN extension = '.py' THEN 'SourceCode'
  WHEN regexp_matches(extension, '^\\.(txt|md)$') THEN 'Documentation' WHEN extension = '.shader' THEN 'ShaderSource' WHEN extension = '.uid' THEN 'GodotResourceUID'
  WHEN extension = '.gdextension' THEN 'GodotExtensionConfig' WHEN extension = '.remap' THEN 'GodotExportRemap' WHEN regexp_matches(extension, '^\\.(node|object|resource)$') THEN 'GodotEditorMetadata'
  WHEN regexp_matches(extension, '^\\.(cfg|ini|conf|config)$') THEN 'Config' WHEN regexp_matches(extension, '^\\.(rst|adoc)$') THEN 'Text'
  WHEN regexp_matches(extension, '^\\.(ya?ml|toml|xml|bytes|dat)$') THEN 'Data' WHEN extension = '.bin' THEN 'BinaryData' WHEN regexp_matches(extension, '^\\.(db|sqlite3?)$') THEN 'Database'
  WHEN regexp_matches(extension, '^\\.(bmp|gif|tga|exr)$') THEN 'Image' WHEN extension = '.ase' THEN 'ColorPalette' WHEN regexp_matches(extension, '^\\.(aseprite|psd|kra)$') THEN 'SourceArt' ELSE 'Unknown' END"""
_OF_F = (lambda case: re.sub(r"\b(is_directory|extension)\b", r"f.\1", case))
TYPED = f"""WITH typed AS (SELECT f.*, {_OF_F(TYPE)} AS file_type, {_OF_F(HINT)} AS engine_type, coalesce(d.id, 0) AS parent_id
  FROM files f LEFT JOIN files d ON f.parent_path = d.path AND NOT d.is_deleted)"""
SHOWN = "id, concat('res://', path) AS path, name, CASE WHEN is_directory THEN 'folder' ELSE 'file' END AS type, extension, file_type, engine_type, size_bytes, modified_ns // 1000000000 AS modified_time_unix, is_directory, is_deleted, parent_id"


def _files(name: str, where: str, order: str = "", **options) -> None:
    key, offset, limit = options.pop("sort", None), options.pop("offset", 0), options.pop("limit", 500)

    @query(name, f"{TYPED} SELECT {SHOWN} FROM typed WHERE {where} {order}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = typed_files(spark, sf_dir, parents=False)
        found = inventory.filter_files(files, **options)
        if key:
            # only a page's rows get their parents; the join loses the order, so the page is sorted again
            found = inventory.page(found, inventory.file_order(key), offset, limit)
        found = resolve.parents(found.withColumn("parent_id", F.lit(0).cast("long")), files)
        return inventory.file_rows(found.orderBy(*inventory.file_order(key)) if key else found)


_files("files_filter_type", "NOT is_deleted AND file_type = 'Script'", file_type="Script")
_files("files_filter_extension", "NOT is_deleted AND extension = '.json'", extension=".json")
_files("files_filter_engine_type", "NOT is_deleted AND engine_type = 'PackedScene'", engine_type="PackedScene")
_files("files_filter_deleted", "is_directory = false", include_deleted=True, is_directory=False)
_files("files_filter_search", f"NOT is_deleted AND ({LIKE('path', '%RED_%1%')} OR {LIKE('name', '%RED_%1%')})", search="RED_%1")
_files("files_page_path", f"NOT is_deleted AND file_type = 'Script'", f"ORDER BY {FOLD('path')}, id LIMIT 500", file_type="Script", sort="path")
_files("files_page_name", "NOT is_deleted", f"ORDER BY {FOLD('name')}, id LIMIT 100 OFFSET 50", sort="name", offset=50, limit=100)
_files("files_page_modified", "NOT is_deleted", "ORDER BY modified_ns DESC, id LIMIT 500", sort="modified_time", limit=501, offset=-3)
_files("files_page_type", "NOT is_deleted", "ORDER BY file_type, path LIMIT 300", sort="file_type", limit=300)


_laid: dict[tuple[str, str, str], str] = {}


def laid_files(spark: SparkSession, sf_dir: str, sort: str) -> str:
    """The folder of the files laid out in an order; one for each session and folder of tables."""
    import uuid

    from arbordex.operators.lineage import checkpoint_folder

    key = (spark.sparkContext.applicationId, sf_dir, sort)
    if key not in _laid:
        folder = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4().hex}"
        pages.lay(inventory.filter_files(typed_files(spark, sf_dir)), inventory.file_order(sort), folder)
        _laid[key] = folder
    return _laid[key]


@query("files_page_laid", f"{TYPED} SELECT {SHOWN} FROM typed WHERE NOT is_deleted ORDER BY modified_ns DESC, id LIMIT 400 OFFSET 150")
def files_page_laid(spark, sf_dir):
    """A page down the list, read from an order on disk."""
    return inventory.file_rows(pages.page(spark, laid_files(spark, sf_dir, "modified_time"), 150, 400))


@query("files_page_laid_search", f"{TYPED} SELECT {SHOWN} FROM typed WHERE NOT is_deleted AND file_type = 'Script' AND {LIKE('path', '%a%')} ORDER BY {FOLD('name')}, id LIMIT 50 OFFSET 3")
def files_page_laid_search(spark, sf_dir):
    """A page of what a filter keeps of an order on disk."""
    keep = lambda df: inventory.filter_files(df, file_type="Script").where(text.contains_like(F.col("path"), "a"))
    return inventory.file_rows(pages.page(spark, laid_files(spark, sf_dir, "name"), 3, 50, keep))


@query("files_filter_parent", f"{TYPED} SELECT {SHOWN} FROM typed WHERE NOT is_deleted AND parent_id = (SELECT min(id) FROM files WHERE is_directory)")
def files_filter_parent(spark, sf_dir):
    files = typed_files(spark, sf_dir)
    first = files.where("is_directory").agg(F.min("id")).first()[0]
    return inventory.file_rows(inventory.filter_files(files, parent_id=first))


@query("file_details", f"{TYPED} SELECT {SHOWN} FROM typed WHERE id = 42")
def file_details(spark, sf_dir):
    return inventory.file_rows(typed_files(spark, sf_dir).where("id = 42"))


@query("count_files", "SELECT count(*) AS n FROM files WHERE NOT is_deleted AND NOT is_directory")
def count_files(spark, sf_dir):
    return inventory.counted(frame(spark, sf_dir, "files").where("not is_deleted and not is_directory"))


@query("classify_files", f"{TYPED} SELECT id, file_type, engine_type, CASE WHEN engine_type = 'NGT' THEN 'none' ELSE 'extension' END AS type_hint_source, CASE WHEN engine_type = 'NGT' THEN 0 ELSE 50 END AS type_hint_confidence FROM typed")
def classify_files(spark, sf_dir):
    hint = F.col("engine_type")
    return typed_files(spark, sf_dir, parents=False).select("id", "file_type", "engine_type", F.when(hint == classify.NOT_TYPED, "none").otherwise("extension").alias("type_hint_source"), classify.hint_confidence(hint).alias("type_hint_confidence"))


@query("legacy_taxonomy", f"SELECT id, {LABEL} AS label FROM files")
def legacy_taxonomy(spark, sf_dir):
    return frame(spark, sf_dir, "files").select("id", taxonomy.label(F.col("path"), F.col("is_directory")).alias("label"))


#: A path for every pattern of every rule, given to parts in turn.
_RULE_PATHS = [{"extension": "d/x" + p, "name": "d/" + p, "under": p + "x", "suffix": "d/y" + p}[kind] for _, kind, values in taxonomy.RULES for p in values.split()] + ["d/none", "d/.none", "D/X.GD"]
_RULE_PATH = f"split_part('{','.join(_RULE_PATHS)}', ',', CAST(p_partkey % {len(_RULE_PATHS)} AS INTEGER) + 1)"


@query("taxonomy_every_rule", f"SELECT p_partkey, path, {taxonomy.sql_case('lower(path)', 'name', 'extension')} AS label FROM (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS extension FROM (SELECT p_partkey, path, lower(regexp_extract(path, '[^/]*$')) AS name FROM (SELECT p_partkey, {_RULE_PATH} AS path FROM part)))")
def taxonomy_every_rule(spark, sf_dir):
    """Labels by the table of rules; each rule has its files."""
    files = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{_RULE_PATH} AS path")
    return taxonomy.labelled(files, "path", F.lit(False), taxonomy.rule_rows(spark))


@query("type_histogram", f"{TYPED} SELECT file_type, engine_type, count(*) AS n FROM typed WHERE NOT is_deleted GROUP BY ALL")
def type_histogram(spark, sf_dir):
    return typed_files(spark, sf_dir, parents=False).where("not is_deleted").groupBy("file_type", "engine_type").agg(F.count("*").alias("n"))


@query("parent_resolve", f"{TYPED} SELECT id, parent_path, parent_id FROM typed")
def parent_resolve(spark, sf_dir):
    return typed_files(spark, sf_dir).select("id", "parent_path", "parent_id")


MESSY = "concat(CASE page_id % 4 WHEN 0 THEN 'res://' WHEN 1 THEN './' WHEN 2 THEN '/' ELSE '' END, replace(url, '://', CASE page_id % 3 WHEN 0 THEN '\\' WHEN 1 THEN '/../' ELSE '/./' END), CASE page_id % 5 WHEN 0 THEN '/../X.TSCN' WHEN 1 THEN '//a.b.Gd' WHEN 2 THEN '/.gitignore' ELSE '' END)"
NORMAL = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(p, '\\', '/'), '^res://', ''), '^(\\./)+', ''), '^/+', ''), '/'), lambda s: [s])),
  lambda a, s: CASE WHEN s[1] IN ('', '.') THEN a WHEN s[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END)"""


def _messy(spark, sf_dir):
    return spark.sql(f"SELECT page_id, {MESSY.replace(chr(92), chr(92) * 2)} AS p FROM {{pages}}", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("normalize_path", f"SELECT page_id, array_to_string({NORMAL}, '/') AS path FROM (SELECT page_id, {MESSY} AS p FROM pages)")
def normalize_path(spark, sf_dir):
    return _messy(spark, sf_dir).select("page_id", text.normalize_path(F.col("p")).alias("path"))


@query("extension_of", f"SELECT page_id, {EXTENSION} AS extension, name FROM (SELECT page_id, coalesce(regexp_extract(array_to_string({NORMAL}, '/'), '[^/]*$'), '') AS name FROM (SELECT page_id, {MESSY} AS p FROM pages))")
def extension_of(spark, sf_dir):
    path = text.normalize_path(F.col("p"))
    return _messy(spark, sf_dir).select("page_id", path.alias("path")).select("page_id", text.extension_of(F.col("path")).alias("extension"), text.file_name(F.col("path")).alias("name"))


@query("dirty_path_filter", "SELECT id, path FROM files WHERE path = 'Brand_11' OR starts_with(path, 'Brand_11/') OR path = 'Brand_2' OR starts_with(path, 'Brand_2/')")
def dirty_path_filter(spark, sf_dir):
    return frame(spark, sf_dir, "files").where(text.under_any(F.col("path"), ["Brand_11", "Brand_2", "Brand_11"])).select("id", "path")


REASON = """CASE WHEN o.path IS NULL THEN 'new_path' WHEN o.kind <> n.kind THEN 'kind_changed' WHEN n.kind = 'file' AND o.size_bytes <> n.size_bytes THEN 'size_changed' WHEN n.kind = 'file' AND o.modified_ns <> n.modified_ns THEN 'modified_time_changed'
 WHEN o.file_identity <> '' AND n.file_identity <> '' AND o.file_identity <> n.file_identity THEN 'file_identity_changed' WHEN o.parser_version <> 2 THEN 'parser_version_changed' WHEN o.dependency_parser_version <> 1 THEN 'dependency_parser_version_changed'
 WHEN o.classifier_version <> 2 THEN 'classifier_version_changed' WHEN o.parse_status IN ('io_error', 'malformed') THEN 'prior_parse_failed_retry' ELSE 'clean' END"""
SCENE = "CASE WHEN o.path IS NOT NULL AND n.path LIKE '%.tscn' AND o.scene_parser_version <> 1 THEN 'scene_parser_version_changed' ELSE {} END".format
CHANGED = f"WITH changed AS (SELECT n.*, {SCENE(REASON)} AS dirty_reason FROM new_rows n LEFT JOIN (SELECT * FROM old_rows WHERE NOT is_deleted) o ON o.path = n.path)"


def changed(spark, sf_dir, **options):
    return snapshot.diff(frame(spark, sf_dir, "new_rows"), frame(spark, sf_dir, "old_rows").where("not is_deleted"), versions=VERSIONS, scene_version=1, **options)


@query("snapshot_diff", f"{CHANGED} SELECT * FROM changed")
def snapshot_diff(spark, sf_dir):
    return changed(spark, sf_dir)


@query("snapshot_diff_forced", f"SELECT n.path, {SCENE('''CASE WHEN o.path IS NULL THEN 'new_path' ELSE 'force_rescan' END''')} AS dirty_reason FROM new_rows n LEFT JOIN (SELECT * FROM old_rows WHERE NOT is_deleted) o ON o.path = n.path")
def snapshot_diff_forced(spark, sf_dir):
    return changed(spark, sf_dir, force=True).select("path", "dirty_reason")


@query("snapshot_diff_dirty_paths", f"SELECT n.path, {SCENE('''CASE WHEN o.path IS NULL THEN 'new_path' WHEN n.path = 'c/7.gd' OR starts_with(n.path, 'c/7.gd/') OR n.path = 'c/23.tscn' THEN 'watcher_invalidated' ELSE 'clean' END''')} AS dirty_reason FROM new_rows n LEFT JOIN (SELECT * FROM old_rows WHERE NOT is_deleted) o ON o.path = n.path")
def snapshot_diff_dirty_paths(spark, sf_dir):
    return changed(spark, sf_dir, dirty_paths=["c/7.gd", "c/23.tscn"]).select("path", "dirty_reason")


@query("dirty_reason_counts", f"{CHANGED} SELECT dirty_reason, count(*) AS n FROM changed GROUP BY 1")
def dirty_reason_counts(spark, sf_dir):
    return snapshot.reason_counts(changed(spark, sf_dir))


@query("count_new_rows", "SELECT count(*) AS n FROM new_rows WHERE path NOT IN (SELECT path FROM old_rows)")
def count_new_rows(spark, sf_dir):
    return inventory.counted(snapshot.new_rows(frame(spark, sf_dir, "new_rows"), frame(spark, sf_dir, "old_rows")))


@query("count_updated_rows", f"{CHANGED} SELECT count(*) AS n FROM changed WHERE dirty_reason <> 'clean' AND path IN (SELECT path FROM old_rows)")
def count_updated_rows(spark, sf_dir):
    return inventory.counted(snapshot.known_rows(changed(spark, sf_dir).where("dirty_reason <> 'clean'"), frame(spark, sf_dir, "old_rows")))


MERGED = f"""{CHANGED}, merged AS (SELECT coalesce(f.path, s.path) AS path, {", ".join(f"CASE WHEN s.path IS NOT NULL AND (f.path IS NULL OR dirty_reason <> 'clean') THEN s.{v} ELSE f.{v} END AS {v}" for v in ("kind", "size_bytes", "modified_ns"))},
 coalesce(f.first_seen, 2) AS first_seen, CASE WHEN s.path IS NOT NULL THEN 2 ELSE f.last_seen END AS last_seen,
 CASE WHEN s.path IS NOT NULL AND (f.path IS NULL OR dirty_reason <> 'clean') THEN false ELSE f.is_deleted END AS is_deleted,
 CASE WHEN s.path IS NULL THEN 'unseen' WHEN f.path IS NULL THEN 'inserted' WHEN dirty_reason <> 'clean' THEN 'updated' ELSE 'refreshed' END AS merge_state
 FROM old_rows f FULL JOIN changed s ON f.path = s.path)"""
STONES = f"{MERGED}, stones AS (SELECT path, is_deleted OR last_seen <> 2 AS is_deleted, CASE WHEN NOT is_deleted AND last_seen <> 2 THEN 'deleted_path' ELSE '' END AS dirty_reason FROM merged)"


def merged(spark, sf_dir):
    return merge.upsert(frame(spark, sf_dir, "old_rows"), changed(spark, sf_dir), ["kind", "size_bytes", "modified_ns"], 2)


@query("merge_upsert", f"{MERGED} SELECT * FROM merged")
def merge_upsert(spark, sf_dir):
    return merged(spark, sf_dir)


@query("merge_counts", f"{MERGED} SELECT merge_state, count(*) AS n FROM merged GROUP BY 1")
def merge_counts(spark, sf_dir):
    return merged(spark, sf_dir).groupBy("merge_state").agg(F.count("*").alias("n"))


@query("tombstone", f"{STONES} SELECT * FROM stones")
def tombstone(spark, sf_dir):
    return merge.tombstone(merged(spark, sf_dir), 2).select("path", "is_deleted", "dirty_reason")


@query("deleted_log", f"{STONES} SELECT path, 2 AS generation FROM stones WHERE dirty_reason = 'deleted_path' UNION ALL SELECT path, CASE WHEN size_bytes > 9 THEN 2 ELSE 1 END FROM old_rows WHERE size_bytes < 12 AND (size_bytes <= 9 OR path NOT IN (SELECT path FROM stones WHERE dirty_reason = 'deleted_path'))")
def deleted_log(spark, sf_dir):
    log = frame(spark, sf_dir, "old_rows").where("size_bytes < 12").select("path", F.when(F.col("size_bytes") > 9, 2).otherwise(1).cast("long").alias("generation"))
    return merge.deleted_log(log, merge.tombstone(merged(spark, sf_dir), 2), 2)


@query("next_generation", "SELECT CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS next_generation FROM orders")
def next_generation(spark, sf_dir):
    return inventory.next_generation(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")


@query("metrics_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def metrics_latest(spark, sf_dir):
    return inventory.latest(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("list_projects", "SELECT * FROM projects ORDER BY last_seen DESC, id DESC")
def list_projects(spark, sf_dir):
    """The projects as a registry keeps them, in its order."""
    import uuid

    from arbordex.operators.lineage import checkpoint_folder
    from arbordex.registry import PROJECTS, Registry

    known = Registry(spark, f"{checkpoint_folder(spark)}/registry-{uuid.uuid4().hex}")
    rows = frame(spark, sf_dir, "projects")
    known.replace(rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in PROJECTS.split(", "))]))
    return known.projects().select(*rows.columns)


@query("project_summary", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM classes) AS classes, (SELECT count(*) FROM symbols) AS symbols, (SELECT max(o_orderkey) FROM orders) AS latest_run")
def project_summary(spark, sf_dir):
    out = None
    for name in ("files", "classes", "symbols"):
        one = frame(spark, sf_dir, name).agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
        out = one if out is None else out.join(one, "_one")
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey").alias("latest_run")).withColumn("_one", F.lit(1))
    return out.join(runs, "_one").drop("_one")


@query("register_project", """SELECT w.uid, w.root, coalesce(u.id, r.id) AS project_id, CASE WHEN w.uid = '' THEN 'error_empty_uid' WHEN w.root = '' THEN 'error_empty_root' WHEN u.id <> r.id THEN 'error_two_projects'
 WHEN u.id IS NULL AND r.id IS NOT NULL THEN 'error_root_taken' WHEN u.id IS NOT NULL THEN 'update' ELSE 'insert' END AS action FROM wanted w LEFT JOIN projects u ON u.uid = w.uid LEFT JOIN projects r ON r.root = w.root""")
def register_project(spark, sf_dir):
    return merge.register(frame(spark, sf_dir, "projects"), frame(spark, sf_dir, "wanted"))


@query("classes_page", f"SELECT * FROM classes ORDER BY {FOLD('base_type')}, class_name LIMIT 500")
def classes_page(spark, sf_dir):
    return inventory.page(frame(spark, sf_dir, "classes"), inventory.class_order("base_type"))


@query("classes_filter", f"SELECT * FROM classes WHERE language = 'CSharp' AND ({LIKE('class_name', '%7%')} OR {LIKE('script_path', '%7%')})")
def classes_filter(spark, sf_dir):
    return inventory.filter_classes(frame(spark, sf_dir, "classes"), language="CSharp", search="7")


@query("classes_count", "SELECT count(*) AS n FROM classes WHERE language = 'GDScript'")
def classes_count(spark, sf_dir):
    return inventory.counted(inventory.filter_classes(frame(spark, sf_dir, "classes"), language="GDScript"))


def _symbols(name: str, where: str, **options) -> None:
    @query(name, f"SELECT * FROM symbols WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inventory.ordered(inventory.filter_symbols(frame(spark, sf_dir, "symbols"), **options), *resolve.PLACE)


_symbols("symbols_for_file", "file_id = 7", file_id=7)
_symbols("functions_for_file", "file_id = 7 AND kind = 'function'", file_id=7, kind="function")
_symbols("properties_for_file", "file_id = 7 AND kind = 'property'", file_id=7, kind="property")
_symbols("symbols_search", f"{LIKE('name', '%S4%')} OR {LIKE('symbol_name', '%S4%')} OR {LIKE('class_name', '%S4%')}", search="S4", over=tuple(NAMES))


@query("symbol_details", "SELECT * FROM symbols WHERE id = (SELECT min(id) FROM symbols)")
def symbol_details(spark, sf_dir):
    symbols = frame(spark, sf_dir, "symbols")
    return symbols.join(F.broadcast(symbols.agg(F.min("id").alias("id"))), "id", "left_semi")


@query("symbol_parent_resolve", "SELECT s.id, s.file_id, s.parent_slot, p.id AS parent_id FROM symbols s LEFT JOIN symbols p ON p.file_id = s.file_id AND p.slot = s.parent_slot")
def symbol_parent_resolve(spark, sf_dir):
    return resolve.symbol_parents(frame(spark, sf_dir, "symbols")).select("id", "file_id", "parent_slot", "parent_id")


@query("parameters_for_function", """WITH f AS (SELECT file_id, id, slot FROM symbols WHERE id = (SELECT min(id) FROM symbols WHERE kind = 'function')), up AS (SELECT s.*, p.id AS parent_id FROM symbols s LEFT JOIN symbols p ON p.file_id = s.file_id AND p.slot = s.parent_slot)
 SELECT up.id, up.slot FROM up JOIN f ON up.file_id = f.file_id WHERE kind = 'parameter' AND (parent_id = f.id OR (parent_id IS NULL AND parent_slot = f.slot)) ORDER BY up.slot, up.id""")
def parameters_for_function(spark, sf_dir):
    symbols = resolve.symbol_parents(frame(spark, sf_dir, "symbols"))
    first = symbols.where("kind = 'function'").agg(F.min("id")).first()[0]
    return resolve.parameters(symbols, first).select("id", "slot").orderBy("slot", "id")


RANKED = "row_number() OVER (PARTITION BY r.id ORDER BY {}) AS pick".format


BEST_SOURCE = f"""WITH m AS (SELECT r.id, s.id AS source_symbol_id, {RANKED('''CASE WHEN s.slot = r.slot THEN 0 WHEN s.kind = 'class' THEN 1 ELSE 2 END, s.line, s."column", s.slot, s.id''')}
 FROM refs r LEFT JOIN symbols s ON s.file_id = r.file_id AND (r.slot IS NULL OR s.slot = r.slot OR s.kind = 'class')) SELECT id, source_symbol_id FROM m WHERE pick = 1"""


@query("best_match_source_symbol", BEST_SOURCE)
def best_match_source_symbol(spark, sf_dir):
    return resolve.source_symbol(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols")).select("id", "source_symbol_id")


@query("asof_enclosing_symbol", """WITH c AS (SELECT file_id, min(struct_pack(l := line, c := "column", s := slot, i := id)).i AS class_id FROM symbols WHERE kind = 'class' GROUP BY 1)
 SELECT r.id, coalesce(s.id, c.class_id) AS enclosing_id FROM refs r ASOF LEFT JOIN (SELECT * FROM symbols WHERE kind <> 'parameter') s ON r.file_id = s.file_id AND r.line >= s.line LEFT JOIN c ON c.file_id = r.file_id""")
def asof_enclosing_symbol(spark, sf_dir):
    return resolve.enclosing_symbol(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols")).select("id", "enclosing_id")


@query("target_by_path", "SELECT l.id, f.id AS target_id FROM (SELECT id, path AS target_path FROM declared_refs) l LEFT JOIN files f ON f.path = l.target_path AND NOT f.is_deleted".replace("declared_refs", "(SELECT p_partkey AS id, concat(replace(p_brand, '#', '_'), '/', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), '.gd') AS path FROM part)"))
def target_by_path(spark, sf_dir):
    refs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr("concat(replace(p_brand, '#', '_'), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey AS STRING), '.gd')").alias("target_path"))
    return resolve.target_by_path(refs, frame(spark, sf_dir, "files")).select("id", "target_id")


BY_CLASS = f"""WITH m AS (SELECT r.id, coalesce(r.target_id, s.file_id) AS target_id, {RANKED('s.file_id, s.line, s."column", s.slot, s.id')} FROM refs r
 LEFT JOIN symbols s ON s.kind = 'class' AND r.target_class IN (s.name, s.symbol_name, s.class_name))"""


@query("target_by_class", f"{BY_CLASS} SELECT id, target_id FROM m WHERE pick = 1")
def target_by_class(spark, sf_dir):
    return resolve.target_by_class(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols"), NAMES).select("id", "target_id")


TARGET_SYMBOL = f"""WITH m AS (SELECT r.*, s.id AS target_symbol_id, {RANKED('s.file_id, s.line, s."column", s.slot, s.id')} FROM refs r
 LEFT JOIN symbols s ON r.target_name IN (s.name, s.symbol_name) AND (r.target_id IS NULL OR s.file_id = r.target_id))"""


@query("target_symbol", f"{TARGET_SYMBOL} SELECT id, target_symbol_id FROM m WHERE pick = 1")
def target_symbol(spark, sf_dir):
    return resolve.target_symbol(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols"), NAMES[:2]).select("id", "target_symbol_id")


RESOLVED = "target_id IS NOT NULL OR target_symbol_id IS NOT NULL"


def resolved(spark, sf_dir):
    return resolve.resolution(resolve.target_symbol(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols"), NAMES[:2]))


@query("reference_resolution", f"{TARGET_SYMBOL} SELECT id, target_id, target_symbol_id, {RESOLVED} AS is_resolved, NOT is_dynamic AND NOT ({RESOLVED}) AS is_unresolved FROM m WHERE pick = 1")
def reference_resolution(spark, sf_dir):
    return resolved(spark, sf_dir).select("id", "target_id", "target_symbol_id", "is_resolved", "is_unresolved")


@query("dependency_resolution", f"{BY_CLASS.replace('r.id,', 'r.id, r.is_dynamic, r.target_class,')} SELECT m.id, coalesce(m.target_id, c.file_id) AS target_id, coalesce(m.target_id, c.file_id) IS NOT NULL AS is_resolved, NOT is_dynamic AND coalesce(m.target_id, c.file_id) IS NULL AS is_unresolved FROM m LEFT JOIN classes c ON c.class_name = m.target_class WHERE pick = 1")
def dependency_resolution(spark, sf_dir):
    found = resolve.target_by_class(frame(spark, sf_dir, "refs"), frame(spark, sf_dir, "symbols"), NAMES)
    found = resolve.resolution(resolve.target_by_declaration(found, frame(spark, sf_dir, "classes")))
    return found.select("id", "target_id", "is_resolved", "is_unresolved")


@query("resolution_counts", f"{TARGET_SYMBOL} SELECT count(*) AS refs, count(*) FILTER ({RESOLVED}) AS resolved, count(*) FILTER (NOT is_dynamic AND NOT ({RESOLVED})) AS unresolved, count(*) FILTER (is_dynamic) AS dynamic FROM m WHERE pick = 1")
def resolution_counts(spark, sf_dir):
    return summary.resolution_counts(resolved(spark, sf_dir))


@query("unresolved_refs", f"{TARGET_SYMBOL} SELECT id, file_id, line FROM m WHERE pick = 1 AND NOT is_dynamic AND NOT ({RESOLVED}) ORDER BY file_id, line, id")
def unresolved_refs(spark, sf_dir):
    return resolved(spark, sf_dir).where("is_unresolved").select("id", "file_id", "line").orderBy("file_id", "line", "id")


@query("dynamic_refs", "SELECT id, file_id, line FROM refs WHERE is_dynamic")
def dynamic_refs(spark, sf_dir):
    return frame(spark, sf_dir, "refs").where("is_dynamic").select("id", "file_id", "line").orderBy("file_id", "line", "id")


@query("refs_for_script", "SELECT id, line, kind FROM refs WHERE file_id = 5 AND kind = 'error'")
def refs_for_script(spark, sf_dir):
    return frame(spark, sf_dir, "refs").where("file_id = 5 AND kind = 'error'").select("id", "line", "kind").orderBy("line", "id")


@query("refs_from_symbol", f"{BEST_SOURCE} AND source_symbol_id % 10 = 3")
def refs_from_symbol(spark, sf_dir):
    return best_match_source_symbol(spark, sf_dir).where("source_symbol_id % 10 = 3")


@query("confidence_scale", "SELECT id, CAST(trunc(least(greatest(confidence, 0.0), 1.0) * 1000) AS INTEGER) AS confidence_milli FROM refs")
def confidence_scale(spark, sf_dir):
    return frame(spark, sf_dir, "refs").select("id", text.confidence_milli(F.col("confidence")).alias("confidence_milli"))


@query("flag_mapping", f"SELECT id, CAST({' | '.join(f'(CASE WHEN flags & {1 << a} <> 0 THEN {1 << b} ELSE 0 END)' for a, b in text.SCRIPT_TO_SYMBOL.items())} AS BIGINT) AS flags FROM symbols")
def flag_mapping(spark, sf_dir):
    return frame(spark, sf_dir, "symbols").select("id", text.remap_flags(F.col("flags"), text.SCRIPT_TO_SYMBOL).alias("flags"))


@query("class_registry", "SELECT class_name, path, size FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY path DESC) AS r FROM declared) WHERE r = 1")
def class_registry(spark, sf_dir):
    return merge.class_registry(frame(spark, sf_dir, "declared"))


@query("stale_classes", "SELECT class_name, path AS script_path FROM declared WHERE path NOT IN (SELECT path FROM files WHERE NOT is_deleted)")
def stale_classes(spark, sf_dir):
    return merge.stale_classes(frame(spark, sf_dir, "declared").select("class_name", F.col("path").alias("script_path")), frame(spark, sf_dir, "files")).select("class_name", "script_path")


@query("invalidate_targets", """SELECT scene_id, CASE WHEN f.id IS NOT NULL THEN script_id END AS script_id, resource_id, script_path, script_uid, is_resolved AND f.id IS NOT NULL AS is_resolved, is_unresolved OR f.id IS NULL AS is_unresolved
 FROM attachments LEFT JOIN files f ON f.id = script_id AND NOT f.is_deleted""")
def invalidate_targets(spark, sf_dir):
    return merge.invalidate_targets(frame(spark, sf_dir, "attachments"), frame(spark, sf_dir, "files"), "script_id")


@query("drop_orphans", "SELECT scene_id, script_id FROM attachments WHERE script_id IN (SELECT id FROM files WHERE NOT is_deleted)")
def drop_orphans(spark, sf_dir):
    return merge.drop_orphans(frame(spark, sf_dir, "attachments"), frame(spark, sf_dir, "files"), "script_id").select("scene_id", "script_id")


@query("replace_children", "SELECT id, file_id FROM symbols WHERE file_id % 3 <> 0 UNION ALL SELECT id + 1000000, file_id FROM symbols WHERE file_id % 6 = 0")
def replace_children(spark, sf_dir):
    symbols = frame(spark, sf_dir, "symbols").select("id", "file_id")
    fresh = symbols.where("file_id % 6 = 0").select((F.col("id") + 1000000).alias("id"), "file_id")
    return merge.replace_children(symbols, fresh, symbols.where("file_id % 3 = 0").select("file_id").distinct())


@query("attachment_fill", """WITH k AS (SELECT scene_id, resource_id, max_by(path, slot) AS path, max_by(uid, slot) AS uid FROM resources GROUP BY 1, 2)
 SELECT a.scene_id, script_id, a.resource_id, CASE WHEN script_path = '' THEN coalesce(k.path, '') ELSE script_path END AS script_path, CASE WHEN script_path = '' THEN coalesce(k.uid, '') ELSE script_uid END AS script_uid, is_resolved, is_unresolved
 FROM attachments a LEFT JOIN k ON k.scene_id = a.scene_id AND k.resource_id = a.resource_id""")
def attachment_fill(spark, sf_dir):
    return resolve.fill_attachments(frame(spark, sf_dir, "attachments"), frame(spark, sf_dir, "resources"))


@query("scenes_using_script", "SELECT scene_id, script_id FROM attachments WHERE script_id = 12 ORDER BY scene_id")
def scenes_using_script(spark, sf_dir):
    return frame(spark, sf_dir, "attachments").where("script_id = 12").select("scene_id", "script_id").orderBy("scene_id")


@query("scripts_of_scene", "SELECT scene_id, script_id, is_resolved FROM attachments WHERE scene_id = 33 ORDER BY script_id")
def scripts_of_scene(spark, sf_dir):
    return frame(spark, sf_dir, "attachments").where("scene_id = 33").select("scene_id", "script_id", "is_resolved").orderBy("script_id")


@query("doc_gaps", "SELECT s.* FROM doc_symbols s WHERE NOT EXISTS (SELECT 1 FROM doc_comments d WHERE d.symbol_id = s.id AND d.is_attached)")
def doc_gaps(spark, sf_dir):
    return resolve.doc_gaps(frame(spark, sf_dir, "doc_symbols"), frame(spark, sf_dir, "doc_comments"))


@query("script_summary", f"""{TARGET_SYMBOL}, d AS (SELECT * FROM doc_comments WHERE file_id = 7), s AS (SELECT * FROM symbols WHERE file_id = 7), q AS (SELECT * FROM m WHERE pick = 1 AND file_id = 7)
 SELECT (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM s WHERE kind = 'function') AS functions, (SELECT count(*) FROM s WHERE kind = 'property') AS properties, (SELECT count(*) FROM s WHERE kind = 'parameter') AS parameters,
 (SELECT count(*) FROM d) AS doc_comments, (SELECT count(*) FROM q) AS refs, (SELECT count(*) FROM q WHERE NOT is_dynamic AND NOT ({RESOLVED})) AS unresolved, (SELECT count(*) FROM q WHERE is_dynamic) AS dynamic""")
def script_summary(spark, sf_dir):
    return summary.script_summary(7, frame(spark, sf_dir, "symbols"), frame(spark, sf_dir, "doc_comments"), resolved(spark, sf_dir))


@query("deps_of_script", "SELECT * FROM edges WHERE src = 4")
def deps_of_script(spark, sf_dir):
    return graph.dependencies_of(frame(spark, sf_dir, "edges"), 4)


@query("dependents_of_file", "SELECT * FROM edges WHERE dst = 10")
def dependents_of_file(spark, sf_dir):
    return graph.dependents_of(frame(spark, sf_dir, "edges"), 10)


@query("dependents_of_class", "SELECT id, file_id, line FROM refs WHERE target_class = 's17'")
def dependents_of_class(spark, sf_dir):
    return frame(spark, sf_dir, "refs").where(F.col("target_class") == "s17").select("id", "file_id", "line").orderBy("file_id", "line", "id")


@query("dependency_cycles", """WITH walk(origin, cur, path, depth) AS (SELECT src, dst, concat(CAST(src AS VARCHAR), ',', CAST(dst AS VARCHAR)), 1 FROM edges WHERE dst IS NOT NULL
 UNION ALL SELECT origin, e.dst, concat(path, ',', CAST(e.dst AS VARCHAR)), depth + 1 FROM walk JOIN edges e ON e.src = walk.cur WHERE e.dst IS NOT NULL AND depth < 12 AND strpos(concat(',', path, ','), concat(',', CAST(e.dst AS VARCHAR), ',')) = 0)
 SELECT origin AS source_id, e.dst AS target_id, concat(path, ',', CAST(e.dst AS VARCHAR)) AS cycle_path, CAST(min(depth + 1) AS BIGINT) AS hop_count FROM walk JOIN edges e ON e.src = walk.cur WHERE e.dst = origin GROUP BY 1, 2, 3 ORDER BY hop_count, source_id, cycle_path LIMIT 256""")
def dependency_cycles(spark, sf_dir):
    return graph.cycles(frame(spark, sf_dir, "edges"))


def _slice(depth: int) -> None:
    @query(f"graph_slice_d{depth}", f"""WITH walk(depth, node) AS (SELECT 0, CAST(3 AS BIGINT) UNION SELECT depth + 1, dst FROM walk JOIN edges ON src = node WHERE dst IS NOT NULL AND depth < {min(depth, 16)})
 SELECT * FROM edges WHERE src IN (SELECT node FROM walk)""")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.slice_from(frame(spark, sf_dir, "edges"), 3, depth)


for _depth in (0, 2, 17):
    _slice(_depth)


@query("inventory_prune", "SELECT n.path, n.size_bytes, coalesce(o.first_seen, 3) AS first_seen, 3 AS last_seen FROM new_rows n LEFT JOIN old_rows o ON o.path = n.path")
def inventory_prune(spark, sf_dir):
    return merge.prune(frame(spark, sf_dir, "old_rows"), frame(spark, sf_dir, "new_rows").select("path", "size_bytes"), "path", 3)


@query("unknowns", f"{TYPED} SELECT path, extension FROM typed WHERE file_type = 'Unknown' AND NOT is_deleted")
def unknowns(spark, sf_dir):
    return inventory.filter_files(typed_files(spark, sf_dir, parents=False), file_type="Unknown").select("path", "extension")


@query("autoload_targets", "SELECT c.class_name, c.script_path, f.id AS target_id FROM (SELECT class_name, path AS script_path FROM declared) c LEFT JOIN files f ON f.path = c.script_path")
def autoload_targets(spark, sf_dir):
    declared = frame(spark, sf_dir, "declared").select("class_name", F.col("path").alias("script_path"))
    return declared.join(frame(spark, sf_dir, "files").select(F.col("path").alias("script_path"), F.col("id").alias("target_id")), "script_path", "left")


@query("debug_export", f"{TYPED} SELECT {SHOWN} FROM typed ORDER BY {FOLD('path')}, id")
def debug_export(spark, sf_dir):
    return inventory.file_rows(typed_files(spark, sf_dir).orderBy(*inventory.file_order("path")))


@query("project_uid", "SELECT id, substring(sha256(concat(root, '|', uid)), 1, 40) AS derived_uid FROM projects")
def project_uid(spark, sf_dir):
    return frame(spark, sf_dir, "projects").select("id", F.substring(F.sha2(F.concat_ws("|", "root", "uid"), 256), 1, 40).alias("derived_uid"))




def _scripts(spark: SparkSession, sf_dir: str, form: str, extension: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit(extension)).alias("path"), F.lit(extension).alias("extension"), F.expr(form).alias("content"))


@query("parse_gdscript", """SELECT concat('n/', CAST(n_nationkey AS VARCHAR), '.gd') AS path, 'parsed_class' AS status, concat('C', CAST(n_nationkey AS VARCHAR)) AS class_name, 'Node3D' AS direct_base_type, 4 AS symbols,
 concat('r/', CAST(n_regionkey AS VARCHAR), '.tscn') AS target_path FROM nation""")
def parse_gdscript(spark, sf_dir):
    form = "concat('class_name C', n_nationkey, '\\nextends Node3D\\n## Doc.\\nfunc f(a: int) -> void:\\n\\tpass\\nvar s = preload(\"res://r/', n_regionkey, '.tscn\")\\n')"
    found = scripts.parse_scripts(_scripts(spark, sf_dir, form, ".gd"))
    preload = F.filter("dependencies", lambda d: d["dependency_kind"] == "preload_path")[0]
    return found.select("path", "status", "class_name", "direct_base_type", F.size("symbols").alias("symbols"), preload["target_project_relative_path"].alias("target_path"))


@query("parse_csharp", """SELECT concat('n/', CAST(n_nationkey AS VARCHAR), '.cs') AS path, 'parsed_class' AS status, concat('C', CAST(n_nationkey AS VARCHAR)) AS class_name, 'Node3D' AS direct_base_type,
 concat('r/', CAST(n_regionkey AS VARCHAR), '.tres') AS target_path FROM nation""")
def parse_csharp(spark, sf_dir):
    form = "concat('[GlobalClass]\\npublic partial class C', n_nationkey, ' : Node3D {\\n  void F() { var s = GD.Load<Thing>(\"res://r/', n_regionkey, '.tres\"); }\\n}\\n')"
    found = scripts.parse_scripts(_scripts(spark, sf_dir, form, ".cs"))
    load = F.filter("dependencies", lambda d: d["dependency_kind"] == "gd_load_path")[0]
    return found.select("path", "status", "class_name", "direct_base_type", load["target_project_relative_path"].alias("target_path"))


@query("parse_scene", """SELECT concat('n/', CAST(n_nationkey AS VARCHAR), '.tscn') AS path, concat('r/', CAST(n_regionkey AS VARCHAR), '.gd') AS script_path, concat('Root/N', CAST(n_nationkey AS VARCHAR)) AS node_path, true AS is_resolved FROM nation""")
def parse_scene(spark, sf_dir):
    form = "concat('[ext_resource type=\"Script\" path=\"res://r/', n_regionkey, '.gd\" id=\"1_a\"]\\n[node name=\"N', n_nationkey, '\" parent=\"Root\"]\\nscript = ExtResource(\"1_a\")\\n')"
    found = scripts.parse_scenes(_scripts(spark, sf_dir, form, ".tscn")).select("path", F.explode("script_attachments").alias("a"))
    return found.select("path", F.col("a.script_project_relative_path").alias("script_path"), "a.node_path", "a.is_resolved")


@query("parse_autoload", """SELECT concat('A', CAST(n_nationkey AS VARCHAR)) AS autoload_name, concat('a/', CAST(n_regionkey AS VARCHAR), '.gd') AS target_project_relative_path, n_nationkey % 2 = 0 AS is_singleton FROM nation""")
def parse_autoload(spark, sf_dir):
    form = "concat('[autoload]\\nA', n_nationkey, '=\"', CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE '' END, 'res://a/', n_regionkey, '.gd\" ; note\\n[other]\\nB=1\\n')"
    files = _scripts(spark, sf_dir, form, ".godot").withColumn("path", F.concat(F.col("path"), F.lit("/project.godot")))
    return scripts.parse_project_files(files).select(F.explode("autoloads").alias("a")).select("a.autoload_name", "a.target_project_relative_path", "a.is_singleton")


@query("stream_dirty_batches", "SELECT concat('u', CAST(user_id AS VARCHAR)) AS path, max_by(event_type = 'error', event_id) AS removed, max(event_id) AS seq FROM events GROUP BY 1")
def stream_dirty_batches(spark, sf_dir):
    """The events as a file stream that is stopped half way and goes on in another query; the state of each path after the last batch."""
    import uuid

    from arbordex.operators.lineage import checkpoint_folder
    from arbordex.streaming.states import KeyedStates

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), (F.col("event_type") == "error").alias("removed"), F.col("event_id").alias("seq"))
    folder = f"{checkpoint_folder(spark)}/changes-{uuid.uuid4().hex}"
    for half in (0, 1):  # each half has events before and after those of the other
        changes.where(F.col("seq") % 2 == half).write.mode("append").parquet(f"{folder}/events")
        states = KeyedStates(spark, folder)
        states.start(spark.readStream.schema(changes.schema).parquet(f"{folder}/events")).awaitTermination()
    return states.table()


for _name, _run in trees.QUERIES.items():
    query(_name, trees.ORACLE[_name])(_run)
