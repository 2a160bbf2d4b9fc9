import random
import time

import pytest

from arbordex.sources.scripts import Limits, parse_autoloads, parse_scene, parse_script, unquoted

FULL = b"""# about
class_name Lantern # burns
extends RigidBody2D
## How much is left.
@export var oil: int = 100
const Wick = preload("res://parts/wick.tscn")
signal lit(by: Keeper)
# loose words
func _ready() -> void:
\tvar a: Array[Moth] = []
\tvar b = load("res://q/../glow.tres")
\tload(name)
\tvar c = Ember.new()
func refill(amount: int, source: Barrel = null) -> Receipt:
\treturn NodePath("Hook/Chain")
"""


def kinds(r):
    return [d["dependency_kind"] for d in r["dependencies"]]


def edges(source, extension=".gd"):
    """(kind, text, line, column, path, class, uid, dynamic, unresolved) of each edge."""
    found = parse_script(source.encode(), extension)["dependencies"]
    assert all((d["line_end"], d["column_end"]) == (d["line_start"], d["column_start"]) for d in found)
    return [(d["dependency_kind"], d["reference_text"], d["line_start"], d["column_start"], d["target_project_relative_path"], d["target_class_name"], d["target_resource_uid"], d["is_dynamic"], d["is_unresolved"]) for d in found]


def test_gdscript():
    r = parse_script(FULL, ".gd")
    assert (r["status"], r["class_name"], r["direct_base_type"], r["is_node_type"]) == ("parsed_class", "Lantern", "RigidBody2D", True)
    symbols = [(s["symbol_kind"], s["name"], s["declared_type"], s["return_type"], s["default_value_excerpt"], s["doc_comment_state"]) for s in r["symbols"]]
    assert symbols[1] == ("property", "oil", "int", "", "100", "present")
    assert symbols[4] == ("function", "_ready", "", "void", "", "detached")
    assert symbols[6:] == [("parameter", "amount", "int", "", "", "missing"), ("parameter", "source", "Barrel", "", "null", "missing")]
    assert kinds(r) == ["class_name_declaration", "extends_class", "const_preload_alias", "preload_path", "signal_type_ref", "typed_array_element_ref", "load_path", "dynamic_load", "new_class_instantiation", "typed_param_ref", "typed_return_ref", "scene_node_path"]
    assert [d["source_symbol_local_id"] for d in r["dependencies"]] == [1, 1, 3, 3, 4, 5, 5, 5, 5, 6, 6, 6]
    assert len(r["references"]) == len(r["dependencies"])
    assert all(d["target_symbol_name"] == d["target_class_name"] for d in r["references"])


def test_edges_stand_at_their_argument():
    assert edges('var a = preload("res://x/./y.tscn")\nvar b = load( "res://z.res" )\nResourceLoader.load("res://w.png")\n') == [
        ("preload_path", "res://x/y.tscn", 1, 17, "x/y.tscn", None, None, False, False),
        ("load_path", "res://z.res", 2, 15, "z.res", None, None, False, False),
        ("resource_loader_load_path", "res://w.png", 3, 21, "w.png", None, None, False, False),
    ]


def test_uids_and_dynamic_loads():
    assert edges('var a = preload("uid://b7")\nvar b = preload(which)\nload(which + "x")\nself.load(which)\nload("user://s")\nResourceLoader.load(a.b)\n') == [
        ("resource_uid_ref", "uid://b7", 1, 17, None, None, "uid://b7", False, False),
        ("dynamic_load", "preload(dynamic)", 2, 9, None, None, None, True, False),
        ("dynamic_load", "load(dynamic)", 3, 1, None, None, None, True, False),
        ("dynamic_load", "ResourceLoader.load(dynamic)", 6, 1, None, None, None, True, False),
    ]


def test_a_token_has_one_rule():
    # what extends, const and member calls name starts no rule of its own twice
    assert [e[:2] for e in edges('extends "res://base.gd"\nconst K = preload("res://k.tres")\n@export var t: Torch = null\nexport var u: Urn\n')] == [
        ("extends_path", "res://base.gd"), ("const_preload_alias", "K"), ("preload_path", "res://k.tres"), ("export_type_ref", "Torch"), ("typed_var_ref", "Torch"), ("export_type_ref", "Urn"), ("typed_var_ref", "Urn"),
    ]
    r = parse_script(b'extends "res://base.gd"\n', ".gd")
    assert (r["direct_base_type"], r["is_node_type"], r["is_resource_type"]) == ("ScriptPath", False, False)
    assert [e[:2] for e in edges("func f(\n a: Alpha,\n b: Array[Beta])\n -> Gamma:\n\tpass\nsignal s\nvar d: Dictionary[String, Delta]\nvar e: array[int]\n")] == [("typed_param_ref", "Alpha"), ("typed_array_element_ref", "Beta"), ("typed_return_ref", "Gamma")]


def test_columns_count_bytes():
    assert edges('var é = preload("res://ü/ñ.gd")\n') == [("preload_path", "res://ü/ñ.gd", 1, 18, "ü/ñ.gd", None, None, False, False)]
    r = parse_script("## Größe\nvar g: int = 1 # für\n".encode() + b"var h = '\xff'\n", ".gd")
    assert r["doc_comments"][0]["comment_text"] == "Größe" and len(r["doc_comments"][0]["text_hash"]) == 16
    assert [s["name"] for s in r["symbols"]] == ["g", "h"] and "\ufffd" in r["symbols"][1]["default_value_excerpt"]


def test_csharp_rules():
    source = '[Tool, GlobalClass]\nclass A {}\n[globalclass]\nclass Boat : Hull, IFloat {\n [Export(1)] protected readonly Mast M;\n [Export] int n;\n void F() { gd.load<Sail>("res://s.png"); GD.Load(p); PackedScene.Instantiate<Crew>(); ResourceLoader.Load<Map>(v); }\n}\n'
    assert [(e[0], e[1], e[2]) for e in edges(source, ".cs")] == [
        ("class_name_declaration", "Boat", 4), ("extends_class", "Hull", 4), ("extends_class", "IFloat", 4), ("export_type_ref", "Mast", 5), ("typed_return_ref", "Sail", 7), ("gd_load_path", "res://s.png", 7),
        ("dynamic_load", "GD.Load(dynamic)", 7), ("new_class_instantiation", "Crew", 7), ("typed_return_ref", "Map", 7), ("dynamic_load", "ResourceLoader.Load(dynamic)", 7),
    ]
    r = parse_script(source.encode(), ".cs")
    assert (r["class_name"], r["direct_base_type"]) == ("Boat", "Hull")


def test_strings_and_comments_hide_calls():
    r = parse_script(b'var s = "a \\" load(\\"res://no\\")"\nvar t = """\nload("res://no2")\n"""\n# preload("res://no3")\nvar k = preload("res://seen.tscn")\n', ".gd")
    assert [(d["dependency_kind"], d["target_project_relative_path"]) for d in r["dependencies"]] == [("preload_path", "seen.tscn")]


def test_a_declared_class_has_a_root_symbol():
    r = parse_script(b'@icon("res://i.png") class_name Kite\nvar tail: Ribbon = null\n', ".gd")
    assert [(s["symbol_kind"], s["name"], s["line_start"], s["doc_comment_state"]) for s in r["symbols"]] == [("property", "tail", 2, "missing"), ("class", "Kite", 1, "none")]
    assert (r["status"], r["class_name"]) == ("parsed_class", "Kite")
    assert [(d["dependency_kind"], d["source_symbol_local_id"]) for d in r["dependencies"]] == [("class_name_declaration", 2), ("typed_var_ref", 1)]


def test_limits():
    source = b"".join(b'var v%d = preload("res://a%d.tscn")\n' % (i, i) for i in range(700))
    r = parse_script(source, ".gd", limits=Limits(1000, 1 << 20, 1 << 20, 3))
    assert r["limit_exceeded"] and len(r["dependencies"]) == 3 and r["parse_error"] == "limit_exceeded"
    head, full = parse_script(source, ".gd", "header"), parse_script(source, ".gd")
    assert head["limit_exceeded"] and head["lines_scanned"] <= 240 and not full["limit_exceeded"] and len(full["dependencies"]) == 700


def test_csharp():
    r = parse_script(b'[GlobalClass]\npublic partial class Ogre : CharacterBody3D {\n [Export] public int Hp { get; set; } = 3;\n void F() { GD.Load<PackedScene>("res://a.tscn"); x.Instantiate<Foo>(); ResourceLoader.Load<Tex>("res://b.png"); } // GD.Load("res://no")\n}\n', ".cs")
    assert (r["class_name"], r["direct_base_type"]) == ("Ogre", "CharacterBody3D")
    assert [d["target_project_relative_path"] for d in r["dependencies"] if d["target_project_relative_path"]] == ["a.tscn", "b.png"]
    assert ("property", "Hp", "int") in [(s["symbol_kind"], s["name"], s["declared_type"]) for s in r["symbols"]]


def test_status():
    assert parse_script(None, ".gd")["status"] == "io_error"
    assert parse_script(b"", ".py")["status"] == "unsupported_language"
    assert parse_script(b"extends Node\nfunc _ready(:\n", ".gd")["status"] == "no_class"


def test_scene():
    r = parse_scene(b'[ext_resource type="Script" path="res://p.gd" id="1"]\n[ext_resource type="Script" path="res://q.gd" uid="uid://z" id="1"]\n[node name="Root" type="Node"]\nscript = ExtResource("1")\n[node name="D" parent="."]\nscript = RuntimeLoader\n[node name="E" parent="D"]\nscript = "res://./e.gd"\nscript2 = SubResource("s")\n')
    assert [(x["resource_path"], x["resource_uid"]) for x in r["external_resources"]] == [("q.gd", "uid://z")]
    assert [(a["node_path"], a["attachment_kind"], a["script_project_relative_path"], a["is_dynamic"], a["is_resolved"]) for a in r["script_attachments"]] == [("Root", "ext_resource", "q.gd", False, True), ("D", "unknown", "", True, False), ("D/E", "direct", "e.gd", False, True), ("D/E", "sub_resource", "", False, False)]


def test_autoloads():
    got = parse_autoloads(b'[x]\na="res://no"\n[autoload]\n; c\n# d\nMain="*res://a/main.gd" ; hi\nB=res://b.gd\n')
    assert [(a["autoload_name"], a["target_project_relative_path"], a["is_singleton"]) for a in got] == [("Main", "a/main.gd", True), ("B", "b.gd", False)]
    assert parse_autoloads(None) == []


@pytest.mark.parametrize("seed", range(5))
def test_never_raises(seed):
    rng = random.Random(seed)
    for _ in range(100):
        b = bytes(rng.choices(b"ab\"'\n\t#(){}[]:=->.$@ \\classfuncextendsvar\xff\x00<>", k=rng.randint(0, 400)))
        for e in (".gd", ".cs"):
            parse_script(b, e)
        parse_scene(b)
        parse_autoloads(b)
    assert unquoted("'a'") == "a"


def test_comments_are_whole():
    long = "word " * 60
    source = f"##   {long}\n##  indented  \nfunc f():\n\tpass\n#\n#  \n# plain {long}\nvar a\n"
    first, second = parse_script(source.encode(), ".gd")["doc_comments"]
    assert (first["comment_text"], first["summary_text"], first["text_excerpt"]) == (f"{long}\nindented  ", long.strip(), long.strip())
    assert (second["comment_text"], second["text_excerpt"], second["is_attached"]) == (f"\n\nplain {long}", f"plain {long}".strip(), False)


@pytest.mark.parametrize(
    "source, extension",
    [("var a = 1\n" * (250 << 10), ".gd"), ("var x:" + " " * 500_000 + "!", ".gd"), ("func a( " * 60_000, ".gd"), ("var " * 60_000, ".gd"), ("var a: Array[1 " * 40_000, ".gd")]
    + [(f"x {w}", ".cs") for w in ("a" * 1_000_000, "a(" * 300_000, "a<" * 300_000, "a<b>" * 150_000, "a{ " * 200_000, "class " * 150_000, "event a " * 80_000, "a  " * 200_000 + "{", " " * 500_000 + "x")],
)
def test_time_grows_with_the_source(source, extension):
    began = time.time()
    parse_script(source.encode(), extension)
    assert time.time() - began < 30  # a few seconds where nothing else runs; the former rules took minutes
