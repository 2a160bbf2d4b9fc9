import pytest
from pyspark.sql import functions as F

from arbordex.functions import classify, text


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


@pytest.mark.parametrize(
    ("path", "expected"),
    [("res://art\\sky\\dusk.png", "art/sky/dusk.png"), ("./m/./n//o/../p.tres", "m/n/p.tres"), ("q/..", ""), ("../../../up", "up"), ("", ""), ("//deep//end/", "deep/end"), ("./././z", "z"), ("é/ü.gd", "é/ü.gd")],
)
def test_normalize_path(spark, path, expected):
    assert values(spark, [path], text.normalize_path(F.col("v"))) == [expected]


def test_extension(spark):
    assert values(spark, ["Scripts/Player.GD", "README", ".gitignore", "a.", "x/a.tar.gz"], text.extension_of(F.col("v"))) == [".gd", "", "", "", ".gz"]


def test_like_folds_ascii_only_and_has_no_escape(spark):
    rows = ["ÉCOLE Main", "école main", "a_b", "axb", "50%", "a\\b", None]
    got = lambda s: values(spark, rows, text.contains_like(F.col("v"), s))
    assert got("MAIN") == [True, True, False, False, False, False, None]
    assert got("é") == [False, True, False, False, False, False, None]
    assert got("a_b") == [False, False, True, True, False, True, None]
    assert got("\\") == [False, False, False, False, False, True, None]


def test_classification(spark):
    cases = {"a/b.TSCN": ("GodotScene", "PackedScene"), "x.res": ("GodotResource", "Resource"), ".godot/imported/a.md5": ("GodotImportHash", "NGT"), ".godot/shader_cache/x.cache": ("GodotShaderCache", "NGT"), "plugin.cfg": ("Config", "ConfigFile"), "project.godot": ("Config", "ProjectSettings"), "g.x86_64": ("GeneratedArtifact", "NGT"), "a.tar": ("Archive", "NGT"), "d.sqlite3": ("Database", "NGT"), "m.cpp": ("SourceCode", "NGT"), "q.zzz": ("Unknown", "NGT"), "r.remap": ("Unknown", "ConfigFile"), ".gitignore": ("Config", "NGT")}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", classify.file_type(F.col("p"), F.lit(False)), classify.type_hint(F.col("p"), F.lit(False)))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def test_confidence_and_flags(spark):
    assert values(spark, [0.95, 0.35, 1.5, -1.0], text.confidence_milli(F.col("v")), "v double") == [950, 350, 1000, 0]
    assert values(spark, [0, 2, 2 | 1 << 12], text.remap_flags(F.col("v"), text.SCRIPT_TO_SYMBOL), "v long") == [0, 8, 8 | 512]


def test_taxonomy(spark):
    from arbordex.functions import taxonomy

    cases = {"a/Cargo.lock": "PackageLock", "Makefile": "BuildScript", ".godot/editor/filesystem_cache4": "GodotEditorFilesystemCache", "x/.gitignore": "Git Ignore", "n.yaml": "Data", "s.sql": "DatabaseScript", "b.blend": "GodotResource", "q.zzz": "Unknown"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", taxonomy.label(F.col("p"), F.lit(False)))
    assert dict(map(tuple, df.collect())) == cases
    own = (("Mine", "suffix", ".zzz"), *taxonomy.RULES)
    assert df.select(taxonomy.label(F.lit("q.ZZZ"), F.lit(False), own)).first()[0] == "Mine"


def test_under_any(spark):
    paths = ["a", "a/b", "a/b/c", "ab", "x/a", ""]
    assert values(spark, paths, text.under_any(F.col("v"), ["a/b", "x", "a/b", "q"])) == [False, True, True, False, True, False]
    assert values(spark, paths, text.under_any(F.col("v"), [])) == [False] * 6
    assert values(spark, ["d7/x", "d70/x"], text.under_any(F.col("v"), [f"d{i}" for i in range(50)] + ["none"] * 9)) == [True, False]


def test_rules_as_rows(spark):
    """A table of rules says what the chain of rules says, as a map and as a join."""
    from arbordex.functions import taxonomy

    paths = [{"extension": "d/x" + p, "name": "d/" + p, "under": p + "x", "suffix": "d/y" + p}[kind] for _, kind, values in taxonomy.RULES for p in values.split()]
    paths += ["", "a", "A.GD", "é.ÄB", ".godot/shader_cache", "x.tar.gz", None, "d/requirements.txt", "a.b/c"]
    df = spark.createDataFrame([(p, i % 7 == 0) for i, p in enumerate(paths)], "path string, is_directory boolean")
    expected = {(r.path, r.is_directory): r.label for r in df.withColumn("label", taxonomy.label(F.col("path"), F.col("is_directory"))).collect()}
    rules = taxonomy.rule_rows(spark)
    for literals in (taxonomy.LITERALS, 3):
        got = taxonomy.labelled(df, "path", F.col("is_directory"), rules, literals=literals)
        assert {(r.path, r.is_directory): r.label for r in got.collect()} == expected
    assert len(set(expected.values())) > 25  # some rules come after others that take all their files
    plan = taxonomy.labelled(df, "path", F.col("is_directory"), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    own = spark.createDataFrame([(1, "suffix", "rements.txt", "Late"), (0, "name", "requirements.txt", "Early"), (0, "under", "a.b/", "Under")], taxonomy.TABLE)
    got = {r.path: r.label for r in taxonomy.labelled(df.where("not is_directory"), "path", F.lit(False), own, other="-").collect()}
    assert got.get("d/requirements.txt", "Early") == "Early" and got.get("a.b/c", "Under") == "Under" and got["A.GD" if "A.GD" in got else "a"] == "-"
    assert taxonomy.labelled(df, "path", F.lit(False), rules.limit(0)).where("label <> 'Unknown'").count() == 0
