"""File types and resource types by extension and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbordex.functions.text import extension_of, file_name, fold

#: The file type of each extension.
FILE_TYPES = {
    "GodotScene": ".tscn .scn",
    "GodotResource": ".tres .res .meshlib",
    "Script": ".gd .cs .sh",
    "Shader": ".gdshader .gdshaderinc .shader",
    "GodotImportMetadata": ".import",
    "GodotEditorMetadata": ".node .object .resource",
    "Data": ".json .csv .yaml .yml .toml .xml .dat .bytes",
    "Asset": ".png .jpg .jpeg .webp .svg .bmp .gif .tga",
    "Image": ".exr",
    "Audio": ".wav .mp3 .ogg .opus .flac",
    "Font": ".otf .ttf .fnt .woff .woff2",
    "ModelBackup": ".blend1 .blend2",
    "ModelCache": ".assbin",
    "Model": ".glb .gltf .fbx .obj .dae .blend",
    "Archive": ".zip .7z .rar .tar .gz",
    "Database": ".db .sqlite .sqlite3",
    "BuildArtifact": ".dll .so .dylib .lib .a .o .pdb .exp",
    "Documentation": ".txt .md .rst .adoc",
    "ColorPalette": ".ase",
    "SourceCode": ".c .h .cpp .hpp .py .js .ts .rs .go .java",
    "SourceArt": ".xcf .psd .aseprite .kra",
    "MaterialSource": ".spp",
    "BinaryData": ".bin",
}
#: Names and extensions of configuration files.
CONFIG_EXTENSIONS = ".cfg .ini .conf .config .godot .uid .gdextension"
CONFIG_NAMES = "plugin.cfg project.godot .editorconfig .gitignore .gitattributes"
#: The resource type that an extension hints at.
TYPE_HINTS = {
    "PackedScene": ".tscn .scn .glb .gltf .fbx .dae .blend",
    "Resource": ".tres .res",
    "MeshLibrary": ".meshlib",
    "GDScript": ".gd",
    "CSharpScript": ".cs",
    "Shader": ".gdshader .shader",
    "ShaderInclude": ".gdshaderinc",
    "Texture2D": ".png .jpg .jpeg .webp .svg .bmp .gif .tga",
    "AudioStreamWAV": ".wav",
    "AudioStreamMP3": ".mp3",
    "AudioStreamOggVorbis": ".ogg .opus",
    "FontFile": ".otf .ttf .fnt .woff .woff2",
    "GDExtension": ".gdextension",
    "ResourceUID": ".uid",
    "ConfigFile": ".cfg .ini .conf .config .remap",
}
NOT_TYPED = "NGT"
LANGUAGES = {".gd": "GDScript", ".cs": "CSharp"}


def _by_extension(extension: Column, table: dict[str, str]) -> Column:
    """A map literal: one hash lookup a row, no join."""
    pairs = [F.lit(x) for label, some in table.items() for e in some.split() for x in (e, label)]
    return F.try_element_at(F.create_map(*pairs), extension)


def file_type(path: Column, is_directory: Column) -> Column:
    path, name, extension = fold(path), fold(file_name(path)), extension_of(path)
    return (
        F.when(is_directory, "Folder")
        .when(_by_extension(extension, FILE_TYPES).isNotNull(), _by_extension(extension, FILE_TYPES))
        .when(path.startswith(".godot/imported/") & (extension == ".md5"), "GodotImportHash")
        .when(path.startswith(".godot/shader_cache/") & (extension == ".cache"), "GodotShaderCache")
        .when(extension.isin(CONFIG_EXTENSIONS.split()) | name.isin(CONFIG_NAMES.split()), "Config")
        .when(name.endswith(".x86_64"), "GeneratedArtifact")
        .otherwise("Unknown")
    )


def type_hint(path: Column, is_directory: Column) -> Column:
    name, extension = fold(file_name(path)), extension_of(path)
    return (
        F.when(is_directory, NOT_TYPED)
        .when(_by_extension(extension, TYPE_HINTS).isNotNull(), _by_extension(extension, TYPE_HINTS))
        .when(name == "plugin.cfg", "ConfigFile")
        .when(name == "project.godot", "ProjectSettings")
        .otherwise(NOT_TYPED)
    )


def hint_confidence(hint: Column) -> Column:
    return F.when(hint == NOT_TYPED, 0).otherwise(50)


def language(path: Column) -> Column:
    return F.coalesce(*[F.when(extension_of(path) == e, n) for e, n in LANGUAGES.items()], F.lit(""))


def sql_case(extension: str, table: dict[str, str], other: str) -> str:
    """The same lookup as a CASE that any SQL engine runs."""
    some = " ".join(f"WHEN {extension} IN ({', '.join(repr(e) for e in v.split())}) THEN '{k}'" for k, v in table.items())
    return f"CASE {some} ELSE {other} END"
