"""Scans of small trees, and the lists over them."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from arbordex import project as module
from arbordex.project import Project
from arbordex.registry import Registry, identity, seeded_uid
from arbordex.sources import imports, listing
from arbordex.store import METRICS, Store


def write(root, name, content, ns=None):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    if ns:
        os.utime(path, ns=(ns, ns))


def test_project_end_to_end(spark, tmp_path):
    root, folder = str(tmp_path / "tree"), str(tmp_path / "store")
    write(root, "project.godot", '[autoload]\nMain="*res://scripts/player.gd"\n')
    write(root, "scripts/player.gd", 'class_name Player\nextends Node\n## Doc.\nfunc go(a: int) -> void:\n\tpass\nvar enemy: Enemy = null\nvar s = preload("res://levels/main.tscn")\n')
    write(root, "scripts/enemy.gd", 'class_name Enemy\nextends Node\nvar p: Player = null\nvar m: Missing = null\n')
    write(root, "levels/main.tscn", '[ext_resource type="Script" path="res://scripts/player.gd" id="1"]\n[node name="Root" type="Node"]\nscript = ExtResource("1")\n')
    write(root, ".godot/imported/x.md5", "skipped")
    p = Project(spark, root, folder)
    first = p.scan().first()
    assert (first.status, first.inserted, first.scripts_parsed, first.scenes_parsed) == ("completed", 7, 2, 1)
    assert p.file_count(is_directory=False) == 4 and p.class_count() == 2
    ids = {r.path: r.id for r in p.store.table("files").collect()}
    assert [r.path for r in p.directory_children(ids["scripts"]).collect()] == ["res://scripts/enemy.gd", "res://scripts/player.gd"]
    player, enemy = ids["scripts/player.gd"], ids["scripts/enemy.gd"]
    assert [r.name for r in p.functions_for_script(player).collect()] == ["go"]
    assert [r.name for r in p.parameters_for_function(p.functions_for_script(player).first().id).collect()] == ["a"]
    assert {r.src for r in p.dependents_of_file(player).collect()} == {player, enemy}
    assert "Missing" in {r.target_class for r in p.unresolved_dependencies().collect()}
    assert p.dependency_cycles().count() >= 2 and p.graph_slice(player, 1).count() >= 4
    assert [r.script_id for r in p.scripts_of_scene(ids["levels/main.tscn"]).collect()] == [player]
    assert [r.target_id for r in p.autoloads().collect()] == [player]
    assert "go" not in {r.name for r in p.doc_comment_gaps().collect()}
    assert p.script_summary(player).first().functions == 1
    clean = p.scan().first()
    assert (clean.inserted, clean.updated, clean.refreshed, clean.scripts_parsed) == (0, 0, 7, 0)
    write(root, "scripts/missing.gd", "class_name Missing\n")
    os.remove(os.path.join(root, "scripts/player.gd"))
    third = p.scan().first()
    assert (third.inserted, third.scripts_parsed) == (1, 1)
    attached = p.attachments().collect()
    assert [(a.script_path, a.script_project_path, a.script_id, a.is_resolved) for a in attached] == [("res://scripts/player.gd", "scripts/player.gd", None, False)]
    assert "Missing" in {r.target_class for r in p.unresolved_dependencies().collect()}  # until enemy.gd is parsed again
    assert p.store.table("deleted_log").where("path = 'scripts/player.gd'").count() == 1
    assert p.export_inventory()["file_count"] == 8 and p.summary().first().files == 8
    dirty = {r.path: r.dirty_reason for r in p.scan(persist=False, dirty_paths=["scripts/enemy.gd"]).collect()}
    assert dirty["scripts/enemy.gd"] == "watcher_invalidated" and dirty["levels/main.tscn"] == "clean"


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    """A tree with references between classes, a scene, names outside ASCII, and paths of both kinds."""
    at = tmp_path_factory.mktemp("scanned")
    root = str(at / "tree")
    write(root, "a/grün.gd", "class_name Grove\nextends Node2D\n## Größe.\nvar size: int = 3\nfunc plant(seed: Seed) -> Tree:\n\treturn Tree.new()\n")
    write(root, "a/tree.gd", "class_name Tree\nextends Resource\nvar home = preload(\"res://a/grün.gd\")\nvar icon = preload(\"uid://k3\")\nfunc f(x):\n\tload(x)\n\tpreload(x)\n\tResourceLoader.load(x)\n")
    write(root, "a/seed.cs", "[GlobalClass]\npublic partial class Seed : Node3D {\n [Export] public Tree Grown;\n void G() { GD.Load<PackedScene>(\"res://s/one.tscn\"); PackedScene.Instantiate<Grove>(); gd.load(Grown); }\n}\n")
    write(root, "s/one.tscn", '[ext_resource type="Script" path="res://a/tree.gd" uid="uid://k3" id="7"]\n[ext_resource type="Texture" path="res://none.png" id="8"]\n[node name="Top" type="Node"]\nscript = ExtResource("7")\n[node name="Low" parent="."]\nscript = Made()\n')
    p = Project(spark, root, str(at / "store"))
    row = p.scan().first()
    return p, row, {r.path: r.id for r in p.store.table("files").collect()}


def test_symbols_are_targets_of_references(scanned):
    p, _, ids = scanned
    classes = {r.name: r.id for r in p.store.table("symbols").where("kind = 'class'").collect()}
    found = {(r.kind, r.target_class): (r.target_id, r.target_symbol_id, r.is_resolved) for r in p.references(ids["a/grün.gd"]).collect()}
    assert found[("typed_param_ref", "Seed")] == (ids["a/seed.cs"], classes["Seed"], True)
    assert found[("new_class_instantiation", "Tree")] == (ids["a/tree.gd"], classes["Tree"], True)
    assert found[("extends_class", "Node2D")] == (None, None, False)
    assert {r.target_class for r in p.unresolved_references().collect()} == {"Node2D", "Resource", "Node3D", "PackedScene", ""}  # one is a uid


def test_paths_outside_ascii_bind(scanned):
    p, _, ids = scanned
    [r] = p.references(ids["a/tree.gd"], "preload_path").collect()
    assert (r.target_project_path, r.target_path, r.target_id) == ("a/grün.gd", "res://a/grün.gd", ids["a/grün.gd"])
    assert [d.comment_text for d in p.store.table("doc_comments").collect()] == ["Größe."]


def test_dynamic_and_uid_edges(scanned):
    p, _, ids = scanned
    found = sorted((r.reference_text, r.line, r.column, r.confidence) for r in p.dynamic_dependencies().where(F.col("src") == ids["a/tree.gd"]).collect())
    assert found == [("ResourceLoader.load(dynamic)", 8, 2, 0.35), ("load(dynamic)", 6, 2, 0.35), ("preload(dynamic)", 7, 2, 0.35)]
    kinds = [(r.kind, r.target_uid) for r in p.dependencies_for_script(ids["a/tree.gd"]).where("line = 4").collect()]
    assert kinds == [("resource_uid_ref", "uid://k3")]
    assert [r.reference_text for r in p.dynamic_references(ids["a/seed.cs"]).collect()] == ["GD.Load(dynamic)"]


def test_scene_rows(scanned):
    p, _, ids = scanned
    assert sorted((r.path, r.target_id, r.is_resolved) for r in p.store.table("resources").collect()) == [("a/tree.gd", ids["a/tree.gd"], True), ("none.png", None, False)]
    tree = p.store.table("symbols").where("kind = 'class' and name = 'Tree'").first().id
    found = [(r.node_path, r.script_path, r.script_id, r.script_symbol_id, r.is_dynamic, r.is_unresolved, r.resource_slot, r.resource_uid) for r in p.attachments().collect()]
    assert found == [("Top", "res://a/tree.gd", ids["a/tree.gd"], tree, False, False, "7", "uid://k3"), ("Low", "", None, None, True, False, "", "")]


def test_class_rows(scanned):
    p, _, _ = scanned
    assert [(r.class_name, r.language, r.base_type, r.is_node_type, r.is_resource_type) for r in p.classes_page().collect()] == [("Grove", "GDScript", "Node2D", True, False), ("Seed", "CSharp", "Node3D", True, False), ("Tree", "GDScript", "Resource", False, True)]
    assert p.class_details("Seed").count() == 1 and p.class_details("").count() == 0
    assert p.doc_comment_gaps(search="a/tree", kind="function").count() == 1  # by the path of the file


def test_counts_of_a_run(scanned):
    p, row, _ = scanned
    assert (row.status, row.error, row.files_seen, row.dirs_seen, row.entries_new, row.inserted) == ("completed", "", 4, 2, 6, 6)
    assert (row.scripts_candidates, row.scripts_parsed, row.scenes_parsed, row.attachments_created) == (3, 3, 1, 2)
    assert row.dependencies_created == p.store.table("dependencies").count() and row.symbols_created == p.store.table("symbols").count()
    assert row.dynamic_dependencies == 4 and row.unresolved_dependencies == p.unresolved_dependencies().count()
    assert set(METRICS) <= set(p.scan_status().columns) and p.scan_status(99).count() == 0
    last = p.last_scan_results()
    assert last["summary"].first().generation == 1 and last["files"].count() == 6
    assert [(r.run, r.entries) for r in p.benchmark_scan(2).collect()] == [(1, 6), (2, 6)] and p.parsed_scripts(force=True).count() == 3
    assert p.scan_fast(limit=2).count() == 2 and p.scan_fast().first().asDict()["path"] == "res://a"


def test_versions_are_stamped_only_where_parsed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    for name in "ab":
        write(root, f"{name}.gd", f"class_name {name.upper()}\n")
    p = Project(spark, root, str(tmp_path / "store"))
    assert p.scan().first().scripts_parsed == 2
    monkeypatch.setitem(module.VERSIONS, "parser", 3)
    assert p.scan(dirty_paths=["a.gd"]).first().scripts_parsed == 1
    assert {r.path: r.parser_version for r in p.store.table("files").collect()} == {"a.gd": 3, "b.gd": 2}
    assert p.scan().first().scripts_parsed == 1  # b.gd is still due
    assert p.scan().first().scripts_parsed == 0


def test_a_scan_without_changes_leaves_tables_where_they_are(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, "a.gd", "class_name A\n")
    p = Project(spark, root, str(tmp_path / "store"))
    p.scan()
    before = p.store.current()["tables"]
    p.scan()
    after = p.store.current()["tables"]
    assert after["symbols"] == before["symbols"] and after["files"] != before["files"]
    for _ in range(3):
        p.scan()
    assert p.store.table("symbols").count() == 1 and p.store.table("metrics").count() == 5
    assert len(os.listdir(tmp_path / "store" / "versions")) - len([f for f in os.listdir(tmp_path / "store" / "versions") if f.endswith(".crc")]) == 2


def test_unread_folders_keep_their_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    write(root, "kept/a.gd", "class_name A\n")
    write(root, "gone/b.gd", "class_name B\n")
    write(root, ".godot/imported/c.md5", "x")
    p = Project(spark, root, str(tmp_path / "store"))
    first = p.scan().first()
    assert (first.errors, first.dirs_skipped) == (0, 1)
    os.remove(os.path.join(root, "gone/b.gd"))
    os.remove(os.path.join(root, "kept/a.gd"))
    real = listing.listed
    broken = spark.createDataFrame([("kept", "error", "denied")], "path string, kind string, error string")
    monkeypatch.setattr(listing, "listed", lambda *a, **b: real(*a, **b).unionByName(broken, allowMissingColumns=True))
    second = p.scan().first()
    assert (second.errors, second.entries_deleted) == (1, 1)
    assert {r.path: r.is_deleted for r in p.store.table("files").where("kind = 'file'").collect()} == {"kept/a.gd": False, "gone/b.gd": True}
    assert [r.class_name for r in p.classes_page().collect()] == ["A"]


def test_failed_and_cancelled_scans_leave_a_row_and_nothing_else(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    write(root, "a.gd", "class_name A\n")
    p = Project(spark, root, str(tmp_path / "store"))
    p.scan()
    tables = {k: v for k, v in p.store.current()["tables"].items() if k != "metrics"}
    write(root, "b.gd", "class_name B\n")
    with monkeypatch.context() as m:
        m.setattr(module.Scan, "scripts", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            p.scan()
    last = p.scan_status().first()
    assert (last.status, last.error, p.last_error) == ("failed", "division by zero", "division by zero")
    with monkeypatch.context() as m:
        m.setattr(module.Scan, "merge", lambda self, *a: (p.cancel(), p.check()))
        assert p.scan().first().status == "cancelled"
    with monkeypatch.context() as m:  # cancelled by another thread, in the middle of a job
        slow = F.udf(lambda x: (time.sleep(30), x)[1], "string")
        m.setattr(module.Scan, "parse", lambda self, changed: changed.withColumn("path", slow("path")).collect())
        threading.Timer(4, p.cancel).start()
        began = time.time()
        assert p.scan().first().status == "cancelled" and time.time() - began < 25
    assert {k: v for k, v in p.store.current()["tables"].items() if k != "metrics"} == tables
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert p.scan().first().inserted == 1 and [r.status for r in p.store.table("metrics").orderBy("generation").collect()] == ["completed", "failed", "cancelled", "cancelled", "completed"]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current() == {"number": 0, "tables": {}}
    store.publish(1, {"a": "g1-x/a"})
    with pytest.raises(OSError):
        Store(spark, str(tmp_path)).publish(1, {})
    (tmp_path / "versions" / ".000000000002").write_text("half a vers")  # a writer that died
    assert store.current()["tables"] == {"a": "g1-x/a"}
    store.publish(2, {"a": "g2-x/a"})
    assert store.current()["number"] == 2


def test_listing_units(spark, tmp_path):
    root = str(tmp_path)
    for i in range(30):
        write(root, f"big/d{i % 5}/e{i}/f{i}.txt", "x")
    os.symlink("big", os.path.join(root, "link"))
    every = {e["path"] for e in listing.walk(root, "", (), True)}
    for wanted in (1, 3, 8, 500):
        found = listing.units(root, (), True, wanted)
        assert len(found) >= min(wanted, 6) and sorted(e["path"] for f, deep in found for e in listing.walk(root, f, (), True, deep)) == sorted(every)
    rows = {r.path: r.kind for r in listing.entries(spark, root).collect()}
    assert set(rows) == every and rows["link"] == "file"


def test_import(spark, tmp_path):
    p = Project(spark, str(tmp_path), str(tmp_path / "store"))
    with pytest.raises(ValueError):
        p.import_inventory({"other": 1})
    given = {"files": [{"project_relative_path": "d", "file_name": "d", "is_directory": 1}, {"project_relative_path": "d/x.gd", "file_name": "x.gd", "extension": ".gd", "size_bytes": 3.9, "godot_type": "", "modified_time_unix": True}, "no dict", {"file_name": "no path"}], "custom_classes": [{"class_name": "X", "script_project_relative_path": "d/x.gd", "direct_base_type": "Node"}, 5]}
    row = p.import_inventory(given).first()
    assert (row.files_seen, row.dirs_seen) == (1, 1)
    found = {r.path: r for r in p.store.table("files").collect()}
    assert (found["d/x.gd"].size_bytes, found["d/x.gd"].engine_type, found["d/x.gd"].modified_ns, found["d/x.gd"].parent_id) == (3, "NGT", 10**9, found["d"].id)
    assert p.class_details("X").first().is_node_type
    p.import_inventory({"files": given["files"][1:]})
    again = {r.path: (r.id, r.first_seen, r.last_seen) for r in p.store.table("files").collect()}
    assert again == {"d/x.gd": (found["d/x.gd"].id, 1, 2)} and p.class_count() == 0
    given = {
        "files": [{"project_relative_path": p, "file_name": p, "extension": e, "file_type": t, "size_bytes": n} for p, e, t, n in (("m.gd", ".gd", "Script", 1), ("u.zzz", ".zzz", "Unknown", 1), ("v.yyy", ".yyy", "Unknown", 1), ("m.gd", ".gd", "Script", 2))],
        "autoloads": [{"autoload_name": "Main", "target_path": "res://old.gd"}, {"autoload_name": "Main", "target_path": "res://m.gd", "target_project_relative_path": "m.gd", "is_singleton": True}, {"autoload_name": "Lost", "target_project_relative_path": "none.gd"}, 7],
        "custom_classes": [{"class_name": "M", "script_project_relative_path": "m.gd", "language": "a"}, {"class_name": "M", "script_project_relative_path": "a.gd", "language": "b"}],
    }
    p.import_inventory(given)
    ids = {r.path: (r.id, r.size_bytes) for r in p.store.table("files").collect()}
    assert ids["m.gd"][1] == 2 and p.class_details("M").first().language == "b"
    assert [tuple(r) for r in p.imported_autoloads().collect()] == [("Lost", "", "none.gd", False, None, 3, 3), ("Main", "res://m.gd", "m.gd", True, ids["m.gd"][0], 3, 3)]
    assert [(r.path, r.extension, r.first_seen) for r in p.unknowns().collect()] == [("u.zzz", ".zzz", 3), ("v.yyy", ".yyy", 3)]
    given["files"].pop(1)
    given["autoloads"] = given["autoloads"][1:2]
    p.import_inventory(given)
    assert [(r.autoload_name, r.first_seen, r.last_seen) for r in p.imported_autoloads().collect()] == [("Main", 3, 4)] and [(r.path, r.first_seen, r.last_seen) for r in p.unknowns().collect()] == [("v.yyy", 3, 4)]
    assert p.scan_status().first().entries_deleted == 1
    assert [imports.as_long(x) for x in (2.7, True, "5", None, float("inf"))] == [2, 1, 0, 0, 0]
    assert [imports.as_text(x) for x in ("a", None, 3)] == ["a", "", "3"] and imports.as_boolean("yes") is False


def test_registry(spark, tmp_path, monkeypatch):
    known, root = Registry(spark, str(tmp_path / "known")), tmp_path / "one"
    root.mkdir()
    first = known.register(str(root), "Zed")
    uid, source, warning = identity(str(root))
    assert (source, warning) == ("uid_file", "") and uid.startswith("arbordex-") and len(uid) == 49
    assert known.register(str(root), "Zed") == first and known.projects().count() == 1
    moved = tmp_path / "moved"
    root.rename(moved)
    assert known.register(str(moved)) == first and known.project(first).first().root == str(moved)
    other = tmp_path / "two"
    other.mkdir()
    assert known.register(str(other), "Alpha") == 2 and [r.id for r in known.projects().collect()] == [2, 1]
    rows = known.projects().drop("is_path_derived_identity")
    known.replace(rows.withColumn("last_seen", F.col("last_seen") + F.when(F.col("id") == 1, 100).otherwise(0)))
    assert [r.id for r in known.projects().collect()] == [1, 2]  # seen last, first
    (moved / ".godot/arbordex/project.uid").write_text(" \tnew-identity \r\n")
    with pytest.raises(ValueError):
        known.register(str(moved))
    assert known.last_error == "error_root_taken" and known.project(0).count() == 0
    blocked = tmp_path / "three"
    blocked.mkdir()
    (blocked / ".godot").write_text("a file where a folder should be")
    uid, source, warning = identity(str(blocked))
    assert (uid, source) == (seeded_uid("path-derived-", str(blocked), str(blocked / "project.godot")), "path_derived") and warning
    known.register(str(blocked))
    assert [r.is_path_derived_identity for r in known.projects().where("id = 3").collect()] == [True]


def test_watcher(spark, tmp_path):
    root, feed = str(tmp_path / "tree"), tmp_path / "feed"
    write(root, "a.gd", "class_name A\n")
    write(root, "b.gd", "class_name B\n")
    feed.mkdir()
    p = Project(spark, root, str(tmp_path / "store"))
    p.scan()
    assert p.watcher.status() == {"running": False, "requires_full_rescan": True, "last_error": ""} and p.watcher.drain() == []
    events = spark.readStream.schema("path string, removed boolean, is_directory boolean").json(str(feed))
    p.watcher.start(events, str(tmp_path / "watch"))
    (feed / "1.json").write_text(json.dumps({"path": "res://b.gd", "removed": False, "is_directory": False}) + "\n")
    p.watcher.query.processAllAvailable()
    assert p.watcher.status()["running"] and p.watcher.dirty_paths() == ["b.gd"]
    assert p.scan_changes().first().scripts_parsed == 1 and p.watcher.drain() == []
    p.watcher.stop()
    assert p.watcher.status()["requires_full_rescan"]


def test_an_import_lets_go_of_what_hung_on_its_losses(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    write(root, "a.gd", "class_name A\nextends B\n")
    write(root, "b.gd", "class_name B\nfunc f():\n\tpass\n")
    p = Project(spark, root, str(tmp_path / "store"))
    p.scan()
    ids = {r.path: r.id for r in p.store.table("files").collect()}
    assert p.dependents_of_file(ids["b.gd"]).where("file_id = %d" % ids["a.gd"]).count() == 1
    with monkeypatch.context() as m:
        m.setattr(module.Scan, "rewrite", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            p.import_inventory({"files": []})
    assert p.scan_status().first().status == "failed" and p.store.table("files").count() == 2
    p.import_inventory({"files": [{"project_relative_path": "a.gd", "file_name": "a.gd", "extension": ".gd"}]})
    assert {r.file_id for r in p.store.table("symbols").collect()} == {ids["a.gd"]}
    [edge] = p.store.table("dependencies").where("target_class = 'B'").collect()
    assert (edge.target_id, edge.is_resolved, edge.is_unresolved) == (None, False, True)


def test_a_changed_script_rewrites_its_own_buckets(spark, tmp_path):
    root = str(tmp_path / "tree")
    for i in range(40):
        write(root, f"s{i}.gd", f"class_name C{i}\nextends C{(i + 1) % 40}\n## Doc.\nfunc f{i}():\n\tpass\n")
    p = Project(spark, root, str(tmp_path / "store"))
    first = p.scan().first()
    before = {k: dict(v) for k, v in p.store.current()["tables"].items() if isinstance(v, dict)}
    rows = {name: sorted(map(repr, p.store.table(name).collect())) for name in before}
    write(root, "s7.gd", "class_name C7\nextends C9\nfunc g():\n\tpass\n")
    second = p.scan().first()
    after = p.store.current()["tables"]
    moved = {name: {k for k in set(before[name]) | set(after[name]) if before[name].get(k) != after[name].get(k)} for name in before}
    ids = {r.path: r.id for r in p.store.table("files").collect()}
    own = {str(ids["s7.gd"] % 16)}
    assert first.buckets_written > 60 and second.buckets_written < 8
    assert moved["symbols"] == moved["dependencies"] == moved["references"] == moved["doc_comments"] == own and len(moved["classes"]) == 1
    assert moved["resources"] == moved["attachments"] == set()
    # the same tables as of a store that was scanned from nothing
    whole = Project(spark, root, str(tmp_path / "other"))
    whole.scan()
    for name in before:
        assert sorted(map(repr, p.store.table(name).collect())) == sorted(map(repr, whole.store.table(name).collect())), name
    assert rows["symbols"] != sorted(map(repr, p.store.table("symbols").collect()))
    os.remove(os.path.join(root, "s8.gd"))  # s7 no longer names it, nobody else does
    os.remove(os.path.join(root, "s9.gd"))  # s7 and, before, s8 name it
    third = p.scan().first()
    assert third.entries_deleted == 2 and third.scripts_parsed == 0
    lost = p.store.table("dependencies").where("target_class = 'C9'").collect()
    assert [(r.file_id, r.target_id, r.is_unresolved) for r in lost] == [(ids["s7.gd"], None, True)]
    assert p.store.table("symbols").where(F.col("file_id").isin(ids["s8.gd"], ids["s9.gd"])).count() == 0
    assert p.class_count() == 38


def test_two_scans_that_end_together(spark, tmp_path):
    root = str(tmp_path / "tree")
    write(root, "a.gd", "class_name A\n")
    one, two = (Project(spark, root, str(tmp_path / "store")) for _ in range(2))
    begun = module.Scan(one, 1, time.time())
    two.scan()
    one.last_error = "lost"
    assert one._ended(begun, "failed").first().generation == 2
    assert [(r.generation, r.status) for r in two.store.table("metrics").orderBy("generation").collect()] == [(1, "completed"), (2, "failed")]
    assert two.store.table("files").count() == 1
