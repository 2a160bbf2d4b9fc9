"""A finer file taxonomy: ordered rules, the first that holds names the file. Callers add rules of their own before or after.

A rule is (label, kind, values): `extension` compares the folded extension, `name` the folded file name, `under` the start of the
folded path, and `suffix` the end of the folded name. `label` takes rules as code; `labelled` takes them as rows of a table (priority, kind,
pattern, label), as many as there are: a file looks up its extension, its name, and its beginnings and ends of the lengths that patterns
have, and the hit with the lowest priority names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.functions.text import extension_of, file_name, fold

Rule = tuple[str, str, str]
TABLE = "priority int, kind string, pattern string, label string"
#: Rules that a plan holds as one map; more are joined.
LITERALS = 2000
#: The core of the taxonomy, in its order.
RULES: tuple[Rule, ...] = (
    ("GodotResource", "extension", ".meshlib .blend"),
    ("GodotScene", "extension", ".tscn .scn"),
    ("GodotResource", "extension", ".tres .res"),
    ("Script", "extension", ".gd .cs .sh"),
    ("Shader", "extension", ".gdshader .gdshaderinc"),
    ("Asset", "extension", ".png .jpg .jpeg .webp .svg .wav .mp3 .ogg"),
    ("GodotImportMetadata", "extension", ".import"),
    ("Config", "extension", ".godot"),
    ("Data", "extension", ".pck .json .csv"),
    ("GeneratedArtifact", "extension", ".x86_64"),
    ("SourceArt", "extension", ".xcf"),
    ("SourceCode", "extension", ".py"),
    ("Documentation", "extension", ".txt .md"),
    ("GodotEditorFilesystemCache", "under", ".godot/editor/filesystem_cache"),
    ("GodotEditorFilesystemUpdate", "under", ".godot/editor/filesystem_update"),
    ("GodotShaderCache", "under", ".godot/shader_cache/"),
    ("GodotProjectConfig", "name", "project.godot"),
    ("GodotPluginConfig", "name", "plugin.cfg"),
    ("GodotIgnore", "name", ".gdignore"),
    ("Git Ignore", "name", ".gitignore"),
    ("Git Attributes", "name", ".gitattributes"),
    ("Git Modules", "name", ".gitmodules"),
    ("EditorConfig", "name", ".editorconfig"),
    ("DockerIgnore", "name", ".dockerignore"),
    ("ShaderSource", "suffix", ".shader"),
    ("GodotResourceUID", "suffix", ".uid"),
    ("GodotExtensionConfig", "suffix", ".gdextension"),
    ("GodotExportRemap", "suffix", ".remap"),
    ("GodotEditorMetadata", "suffix", ".node .object .resource"),
    ("Config", "suffix", ".cfg .ini .conf .config"),
    ("BuildScript", "name", "dockerfile makefile cmakelists.txt justfile taskfile.yml taskfile.yaml"),
    ("BuildConfig", "name", "jenkinsfile procfile docker-compose.yml docker-compose.yaml build.gradle settings.gradle"),
    ("PackageLock", "name", "pipfile.lock gemfile.lock cargo.lock go.sum yarn.lock pnpm-lock.yaml poetry.lock pubspec.lock composer.lock"),
    ("PackageManifest", "name", "pipfile gemfile cargo.toml go.mod pyproject.toml pubspec.yaml"),
    ("OSMetadata", "name", ".ds_store thumbs.db desktop.ini"),
    ("Text", "suffix", ".text .markdown .rst .adoc .org .tex .log"),
    ("Data", "suffix", ".yaml .yml .toml .xml .tsv .jsonl .ndjson .properties .env .lock .bytes .dat .data"),
    ("BinaryData", "suffix", ".bin .blob"),
    ("Database", "suffix", ".db .sqlite .sqlite3 .duckdb .mdb"),
    ("DatabaseScript", "suffix", ".sql"),
    ("Spreadsheet", "suffix", ".xls .xlsx .ods"),
    ("Document", "suffix", ".doc .docx .odt .rtf .pdf .epub"),
    ("Presentation", "suffix", ".ppt .pptx .odp .key"),
    ("Image", "suffix", ".bmp .gif .tga .tif .tiff .ico .exr .hdr"),
    ("Texture", "suffix", ".dds .ktx .ktx2 .pvr .astc"),
    ("ColorPalette", "suffix", ".ase"),
    ("SourceArt", "suffix", ".aseprite .psd .kra"),
)


def _holds(kind: str, values: list[str], path: Column, name: Column, extension: Column) -> Column:
    if kind == "extension":
        return extension.isin(values)
    if kind == "name":
        return name.isin(values)
    out = F.lit(False)
    for v in values:
        out = out | (path.startswith(v) if kind == "under" else name.endswith(v))
    return out


def label(path: Column, is_directory: Column, rules: tuple[Rule, ...] = RULES, other: str = "Unknown") -> Column:
    path, name, extension = fold(path), fold(file_name(path)), extension_of(path)
    out = F.when(is_directory, "Folder")
    for wanted, kind, values in rules:
        out = out.when(_holds(kind, values.split(), path, name, extension), wanted)
    return out.otherwise(other)


def sql_case(path: str, name: str, extension: str, rules: tuple[Rule, ...] = RULES, other: str = "Unknown") -> str:
    """The same rules as a CASE that any SQL engine runs."""

    def holds(kind: str, values: list[str]) -> str:
        if kind in ("extension", "name"):
            return f"{extension if kind == 'extension' else name} IN ({', '.join(map(repr, values))})"
        return " OR ".join(f"starts_with({path}, {v!r})" if kind == "under" else f"ends_with({name}, {v!r})" for v in values)

    return "CASE " + " ".join(f"WHEN {holds(kind, values.split())} THEN '{wanted}'" for wanted, kind, values in rules) + f" ELSE '{other}' END"


def rule_rows(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as rows (TABLE)."""
    return spark.createDataFrame([(i, kind, pattern, wanted) for i, (wanted, kind, values) in enumerate(rules) for pattern in values.split()], TABLE)


def _keys(path: Column, lengths: dict[str, list[int]]) -> Column:
    """What a file is looked up by: kind:pattern of everything that a rule may say about it."""
    low, name = fold(path), fold(file_name(path))
    ends = [F.when(F.char_length(name) >= n, F.concat(F.lit("suffix:"), F.substring(name, -n, n))) for n in lengths.get("suffix", [])]
    starts = [F.when(F.char_length(low) >= n, F.concat(F.lit("under:"), F.substring(low, 1, n))) for n in lengths.get("under", [])]
    return F.array(F.concat(F.lit("extension:"), extension_of(path)), F.concat(F.lit("name:"), name), *ends, *starts)


def labelled(df: DataFrame, path: str, is_directory: Column, rules: DataFrame, other: str = "Unknown", literals: int = LITERALS) -> DataFrame:
    """df with `label` by a table of rules (TABLE); of rules with one priority the smallest label. A few rules are one map in the plan, and
    nothing is exchanged; more are joined by what files are looked up by."""
    best = rules.where("pattern <> ''").groupBy(F.concat_ws(":", "kind", "pattern").alias("key")).agg(F.min(F.struct("priority", "label")).alias("hit"))
    lengths: dict[str, list[int]] = {}
    for kind, n in rules.where("pattern <> '' and kind in ('suffix', 'under')").select("kind", F.char_length("pattern")).distinct().collect():
        lengths.setdefault(kind, []).append(n)
    keys = _keys(F.col(path), {k: sorted(v) for k, v in lengths.items()})
    few = best.limit(literals + 1).collect()
    if len(few) <= literals:
        table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x["priority"]).alias("priority"), F.lit(x["label"]).alias("label")) for r in few for x in (r["key"], r["hit"])]) if few else None
        found = F.array_min(F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.try_element_at(table, k)))["label"] if few else F.lit(None)
        return df.withColumn("label", F.when(is_directory, "Folder").otherwise(F.coalesce(found, F.lit(other))))
    asked = df.select(F.col(path).alias("_path")).distinct().withColumn("key", F.explode(_keys(F.col("_path"), {k: sorted(v) for k, v in lengths.items()})))
    hits = asked.join(best, "key").groupBy("_path").agg(F.min("hit")["label"].alias("_label"))
    named = df.join(hits, F.col(path) == F.col("_path"), "left")
    return named.withColumn("label", F.when(is_directory, "Folder").otherwise(F.coalesce("_label", F.lit(other)))).select(*df.columns, "label")
