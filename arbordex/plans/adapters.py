"""Stand-ins for the inventory's tables, made from the driver's tables by SQL that Spark and the oracle both run.

Each is a SELECT; `frame` runs it in Spark, `with_sql` puts those that a query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Every extension that the file types and resource types know, and some that they don't.
_EXTENSIONS = (
    ".tscn .scn .tres .res .meshlib .gd .cs .sh .gdshader .gdshaderinc .shader .import .node .object .resource .json .csv .yaml .yml .toml .xml .dat "
    ".bytes .png .jpg .jpeg .webp .svg .bmp .gif .tga .exr .wav .mp3 .ogg .opus .flac .otf .ttf .fnt .woff .woff2 .blend1 .blend2 .assbin .glb .gltf "
    ".fbx .obj .dae .blend .zip .7z .rar .tar .gz .db .sqlite .sqlite3 .dll .so .dylib .lib .a .o .pdb .exp .txt .md .rst .adoc .ase .c .h .cpp .hpp "
    ".py .js .ts .rs .go .java .xcf .psd .aseprite .kra .spp .bin .cfg .ini .conf .config .godot .uid .gdextension .remap .md5 .cache .x86_64 .xyz .PNG .Gd"
).split()
_EXTENSION = f"split_part('{','.join(_EXTENSIONS)}', ',', CAST(p_partkey % {len(_EXTENSIONS)} AS INTEGER) + 1)"
_STEM = "concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING))"
_BRAND = "replace(p_brand, '#', '_')"

SQL = {
    "files": f"""SELECT CAST(p_partkey + 1 AS BIGINT) AS id, concat({_BRAND}, '/', {_STEM}, {_EXTENSION}) AS path, {_BRAND} AS parent_path,
  concat({_STEM}, {_EXTENSION}) AS name, lower({_EXTENSION}) AS extension, CAST(p_size AS BIGINT) AS size_bytes, CAST(p_size AS BIGINT) * 1000000007 + p_partkey AS modified_ns,
  false AS is_directory, p_partkey % 13 = 0 AS is_deleted FROM part
  UNION ALL SELECT CAST(100000000 + min(p_partkey) AS BIGINT), {_BRAND}, NULL, {_BRAND}, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, false FROM part GROUP BY p_brand""",
    "old_rows": """SELECT concat('c/', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 20 = 3 THEN '.tscn' ELSE '.gd' END) AS path, CASE WHEN c_custkey % 19 = 0 THEN 'directory' ELSE 'file' END AS kind,
  CAST(c_nationkey AS BIGINT) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS size_bytes, CAST(c_custkey * 10 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS modified_ns,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'x' ELSE c_mktsegment END AS file_identity, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 2 END AS parser_version,
  CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 1 END AS dependency_parser_version, CASE WHEN c_custkey % 40 = 3 THEN 0 ELSE 1 END AS scene_parser_version, 2 AS classifier_version,
  CASE WHEN c_custkey % 31 = 0 THEN 'io_error' ELSE 'parsed_class' END AS parse_status, CAST(1 AS BIGINT) AS first_seen, CAST(1 AS BIGINT) AS last_seen, c_custkey % 37 = 0 AS is_deleted
  FROM customer WHERE c_custkey % 10 <> 0""",
    "new_rows": """SELECT concat('c/', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 20 = 3 THEN '.tscn' ELSE '.gd' END) AS path, 'file' AS kind, CAST(c_nationkey AS BIGINT) AS size_bytes,
  CAST(c_custkey * 10 AS BIGINT) AS modified_ns, c_mktsegment AS file_identity FROM customer WHERE c_custkey % 11 <> 1""",
    "symbols": """SELECT event_id AS id, user_id AS file_id, CASE WHEN event_id % 7 = 0 THEN 'class' WHEN event_type = 'view' THEN 'function' WHEN event_type = 'click' THEN 'property' ELSE 'parameter' END AS kind,
  concat('s', CAST(event_id % 50 AS STRING)) AS name, concat('S', CAST(event_id % 90 AS STRING)) AS symbol_name, concat('c', CAST(event_id % 70 AS STRING)) AS class_name,
  ts AS line, CAST(event_id % 80 AS BIGINT) AS "column", CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS slot,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1 + event_id % 4 AS BIGINT) END AS parent_slot, CAST(event_id % 1024 AS BIGINT) AS flags
  FROM events WHERE event_type IN ('view', 'click', 'signup')""",
    "refs": """SELECT event_id AS id, user_id AS file_id, ts AS line, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS BIGINT) END AS slot, event_type AS kind,
  concat('s', CAST(event_id % 60 AS STRING)) AS target_class, concat('S', CAST(event_id % 100 AS STRING)) AS target_name, value AS confidence, event_id % 9 = 0 AS is_dynamic,
  CASE WHEN event_id % 4 = 0 THEN CAST(1 + user_id % 40 AS BIGINT) END AS target_id
  FROM events WHERE event_type IN ('error', 'purchase')""",
    "edges": """SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst, CAST(n_nationkey AS BIGINT) AS id FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), CASE WHEN n_nationkey % 8 = 4 THEN NULL ELSE CAST((n_nationkey + 5 * n_regionkey + 1) % 25 AS BIGINT) END, CAST(100 + n_nationkey AS BIGINT) FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1000 + c_custkey - c_custkey % 6 + (c_custkey + 1) % 6 AS BIGINT) END, CAST(1000 + c_custkey AS BIGINT) FROM customer
  UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(1000 + c_custkey + 6 AS BIGINT), CAST(10000000 + c_custkey AS BIGINT) FROM customer WHERE c_custkey % 5 = 0""",
    "doc_symbols": "SELECT doc_id AS id, doc_id % 20 AS file_id, source AS kind, lang AS language FROM documents",
    "doc_comments": "SELECT doc_id AS symbol_id, doc_id % 20 AS file_id, quality = 1 AS is_attached FROM labels",
    "attachments": """SELECT DISTINCT CAST(l_orderkey % 500 AS BIGINT) AS scene_id, CAST(l_partkey + 1 AS BIGINT) AS script_id, concat('r', CAST(l_partkey % 10 AS STRING)) AS resource_id,
  CASE WHEN l_partkey % 3 = 0 THEN concat('p', CAST(l_partkey AS STRING)) ELSE '' END AS script_path, '' AS script_uid, l_partkey % 5 <> 0 AS is_resolved, l_partkey % 5 = 0 AS is_unresolved FROM lineitem""",
    "resources": """SELECT CAST(s_suppkey % 500 AS BIGINT) AS scene_id, concat('r', CAST(s_nationkey % 10 AS STRING)) AS resource_id, s_suppkey AS slot, concat('res/', s_name) AS path, concat('uid', CAST(s_suppkey AS STRING)) AS uid FROM supplier""",
    "classes": """SELECT s_suppkey AS id, replace(s_name, ' ', '_') AS class_name, concat('n/', n_name, '/', CAST(s_suppkey AS STRING), '.gd') AS script_path, CASE WHEN s_suppkey % 3 = 0 THEN 'CSharp' ELSE 'GDScript' END AS language, n_name AS base_type,
  CAST(1 + s_suppkey AS BIGINT) AS file_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "declared": f"SELECT p_name AS class_name, concat({_BRAND}, '/', {_STEM}, '.gd') AS path, CAST(p_size AS BIGINT) AS size FROM part",
    "projects": "SELECT c_custkey AS id, concat('uid', CAST(c_custkey AS STRING)) AS uid, concat('root', CAST(c_custkey AS STRING)) AS root, CAST(c_nationkey AS BIGINT) AS last_seen FROM customer WHERE c_custkey % 4 <> 0",
    "wanted": """SELECT CASE WHEN c_custkey % 21 = 0 THEN '' ELSE concat('uid', CAST(c_custkey AS STRING)) END AS uid, CASE WHEN c_custkey % 22 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN concat('root', CAST(c_custkey + 1 AS STRING)) ELSE concat('root', CAST(c_custkey AS STRING)) END AS root FROM customer""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's rows; its tables are read straight from Parquet, so that filters and columns are pushed down."""
    sql = SQL[name].replace('"column"', "`column`")
    tables = sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)", sql)))
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_sql(body: str) -> str:
    """body with the adapters that it names before it."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    return (f"WITH RECURSIVE {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}") if used else body
