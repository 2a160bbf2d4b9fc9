"""The parsers and the classification as SQL functions. `register(spark)` makes them known to a session:

    SELECT f.path, s.name, s.line_start FROM files f, LATERAL script_symbols(f.path, f.content) s WHERE s.symbol_kind = 'function'

Table functions take a path, whose extension tells the language, and a source (binary or text; null: no rows): script_info (one row a
script), script_symbols, script_dependencies, script_references, script_comments, scene_resources, scene_attachments and
project_autoloads. Rows come and go in Arrow batches. Scalar functions are SQL expressions, which the optimiser sees through: file_extension,
file_name_of, parent_folder, file_type_of, type_hint_of and file_label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StructField, StructType

from arbordex.functions import classify, taxonomy, text
from arbordex.sources import scripts
from arbordex.sources.tree import extension_of

Parse = Callable[[bytes, str], dict[str, Any]]


def _script(source: bytes, path: str) -> dict[str, Any]:
    return scripts.parse_script(source, extension_of(path.rpartition("/")[2]))


def _scene(source: bytes, path: str) -> dict[str, Any]:
    return scripts.parse_scene(source)


def _project(source: bytes, path: str) -> dict[str, Any]:
    return {"autoloads": scripts.parse_autoloads(source)}


def _bytes(content: str | bytes) -> bytes:
    return content.encode("utf-8", "surrogateescape") if isinstance(content, str) else bytes(content)


def rows_of(parse: Parse, field: str, fields: StructType):
    """A table function of the rows in one field of what a parser finds."""
    names = fields.names

    class Rows:
        def eval(self, path: str, content: Any) -> Iterator[tuple]:
            if path is not None and content is not None:
                for row in parse(_bytes(content), path)[field]:
                    yield tuple(row.get(n) for n in names)

    return udtf(Rows, returnType=fields, useArrow=True)


def _info(fields: StructType):
    names = fields.names

    class Info:
        def eval(self, path: str, content: Any) -> Iterator[tuple]:
            if path is not None and content is not None:
                found = _script(_bytes(content), path)
                yield tuple(found[n] for n in names)

    return udtf(Info, returnType=fields, useArrow=True)


def _element(schema: str, field: str) -> StructType:
    kind = StructType.fromDDL(schema)[field].dataType
    assert isinstance(kind, ArrayType)
    return kind.elementType


#: name: (parser, field, schema that has it).
TABLES = {
    "script_symbols": (_script, "symbols", scripts.SCRIPT),
    "script_dependencies": (_script, "dependencies", scripts.SCRIPT),
    "script_references": (_script, "references", scripts.SCRIPT),
    "script_comments": (_script, "doc_comments", scripts.SCRIPT),
    "scene_resources": (_scene, "external_resources", scripts.SCENE),
    "scene_attachments": (_scene, "script_attachments", scripts.SCENE),
    "project_autoloads": (_project, "autoloads", scripts.AUTOLOADS),
}


def expressions() -> dict[str, str]:
    """The scalar functions of a path as SQL."""
    fold = lambda x: f"translate({x}, '{text.UPPER}', '{text.LOWER}')"
    name = "element_at(split(path, '/'), -1)"
    low, extension = fold(name), f"regexp_extract({fold(name)}, r'^.+(\\.[^.]+)$', 1)"
    some = lambda values: ", ".join(repr(v) for v in values.split())
    other = (
        f"CASE WHEN startswith({fold('path')}, '.godot/imported/') AND {extension} = '.md5' THEN 'GodotImportHash' "
        f"WHEN startswith({fold('path')}, '.godot/shader_cache/') AND {extension} = '.cache' THEN 'GodotShaderCache' "
        f"WHEN {extension} IN ({some(classify.CONFIG_EXTENSIONS)}) OR {low} IN ({some(classify.CONFIG_NAMES)}) THEN 'Config' "
        f"WHEN endswith({low}, '.x86_64') THEN 'GeneratedArtifact' ELSE 'Unknown' END"
    )
    hint = f"CASE WHEN {low} = 'plugin.cfg' THEN 'ConfigFile' WHEN {low} = 'project.godot' THEN 'ProjectSettings' ELSE '{classify.NOT_TYPED}' END"
    return {
        "file_extension": extension,
        "file_name_of": name,
        "parent_folder": "CASE WHEN instr(path, '/') > 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END",
        "file_type_of": classify.sql_case(extension, classify.FILE_TYPES, other),
        "type_hint_of": classify.sql_case(extension, classify.TYPE_HINTS, hint),
        "file_label": taxonomy.sql_case(fold("path"), low, extension).replace("starts_with(", "startswith(").replace("ends_with(", "endswith("),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for name, (parse, field, schema) in TABLES.items():
        spark.udtf.register(name, rows_of(parse, field, _element(schema, field)))
    plain = StructType([f for f in StructType.fromDDL(scripts.SCRIPT) if not isinstance(f.dataType, ArrayType)])
    spark.udtf.register("script_info", _info(StructType([StructField(f.name, f.dataType) for f in plain])))
    for name, expression in expressions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(path STRING) RETURNS STRING RETURN {expression}")
    return ["script_info", *TABLES, *expressions()]
