"""The SQL functions against the DataFrame functions and parsers that they stand for."""

import pytest
from pyspark.sql import functions as F

from arbordex.functions import classify, taxonomy, text
from arbordex.sources import scripts, sql, tree

GD = "class_name A\nextends Node\n## Doc.\nfunc f(a: int) -> B:\n\tpass\nvar x: B = load('res://b.gd')\n"
SCENE = '[ext_resource type="Script" path="res://a.gd" id="1"]\n[node name="Top" type="Node"]\nscript = ExtResource("1")\n'


@pytest.fixture(scope="module")
def registered(spark):
    names = sql.register(spark)
    assert sql.register(spark) == names  # again is no fault
    return spark


def test_scalars_are_the_columns(registered):
    paths = ["a.gd", "A/B.TSCN", "project.godot", "x/plugin.cfg", ".godot/imported/i.MD5", ".godot/shader_cache/s.cache", "n.x86_64", "none", "e.", ".gitignore", "d/.hidden.gd", "é.ÄB", "q.unknown", "", None, "a/b/c.d/e"]
    df = registered.createDataFrame([(p,) for p in paths], "path string")
    no = F.lit(False)
    columns = {
        "file_extension": text.extension_of(F.col("path")), "file_name_of": text.file_name(F.col("path")), "parent_folder": text.parent_path(F.col("path")), "file_type_of": classify.file_type(F.col("path"), no),
        "type_hint_of": classify.type_hint(F.col("path"), no), "file_label": taxonomy.label(F.col("path"), no),
    }
    for name, column in columns.items():
        got, want = (df.select("path", c.alias("v")).collect() for c in (F.expr(f"{name}(path)"), column))
        assert {r.path: r.v for r in got} == {r.path: r.v for r in want}, name


def test_parsers_under_lateral(registered, tmp_path):
    for path, content in {"s/a.gd": GD, "s/t.tscn": SCENE, "project.godot": '[autoload]\nMain="*res://s/a.gd"\n', "s/empty.gd": ""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(content)
    tree.tree(registered, str(tmp_path)).createOrReplaceTempView("tree_files")
    ask = lambda q: [tuple(r) for r in registered.sql(q).collect()]
    assert ask("SELECT f.path, s.symbol_kind, s.name FROM tree_files f, LATERAL script_symbols(f.path, f.content) s ORDER BY s.local_symbol_id") == [("s/a.gd", s["symbol_kind"], s["name"]) for s in scripts.parse_script(GD.encode(), ".gd")["symbols"]]
    assert ask("SELECT d.dependency_kind, d.target_class_name FROM tree_files f, LATERAL script_dependencies(f.path, f.content) d WHERE d.target_class_name = 'B' ORDER BY 1") == [("typed_return_ref", "B"), ("typed_var_ref", "B")]
    assert ask("SELECT r.reference_kind, count(*) FROM tree_files f, LATERAL script_references(f.path, f.content) r WHERE r.reference_kind = 'load_path' GROUP BY 1") == [("load_path", 1)]
    assert ask("SELECT c.summary_text FROM tree_files f, LATERAL script_comments(f.path, f.content) c") == [("Doc.",)]
    assert ask("SELECT f.path, i.status, i.class_name FROM tree_files f, LATERAL script_info(f.path, f.content) i WHERE file_extension(f.path) = '.gd' ORDER BY 1") == [("s/a.gd", "parsed_class", "A"), ("s/empty.gd", "no_class", "")]
    resource = scripts.parse_scene(SCENE.encode())["external_resources"][0]["resource_path"]
    assert ask("SELECT r.resource_path, a.node_path FROM tree_files f, LATERAL scene_resources(f.path, f.content) r, LATERAL scene_attachments(f.path, f.content) a WHERE f.path = 's/t.tscn'") == [(resource, "Top")]
    assert ask("SELECT a.autoload_name, a.is_singleton FROM tree_files f, LATERAL project_autoloads(f.path, f.content) a WHERE f.path = 'project.godot'") == [("Main", True)]
    assert ask("SELECT count(*) FROM VALUES ('a.gd', NULL), (NULL, 'x'), ('a.txt', 'var x') AS t(p, c), LATERAL script_symbols(t.p, t.c)") == [(0,)]
    # text as well as bytes
    assert ask("SELECT s.name FROM VALUES ('a.gd', 'var größe') AS t(p, c), LATERAL script_symbols(t.p, t.c) s") == ask("SELECT s.name FROM VALUES ('a.gd', encode('var größe', 'UTF-8')) AS t(p, c), LATERAL script_symbols(t.p, t.c) s")
