"""Streams across restarts: keyed states, a tree's changes, and a watcher's place."""

import os
import shutil
import time

import pytest

from arbordex.project import Project
from arbordex.streaming.changes import EVENTS, Watcher, follow
from arbordex.streaming.states import STATES, KeyedStates
from arbordex.streaming.tree_changes import TreeChangesReader, tree_changes


def states(spark, folder, source):
    kept = KeyedStates(spark, str(folder))
    kept.start(spark.readStream.schema(STATES).parquet(str(source))).awaitTermination()
    return kept


def add(spark, source, rows):
    spark.createDataFrame(rows, STATES).coalesce(1).write.mode("append").parquet(str(source))


def test_states_outlive_their_query(spark, tmp_path):
    source, folder = tmp_path / "events", tmp_path / "states"
    assert KeyedStates(spark, str(folder)).table().count() == 0
    add(spark, source, [("a", False, 1), ("b", False, 2), ("a", True, 0), (None, True, 9), ("n", None, 4), ("x", True, None)])
    states(spark, folder, source)
    add(spark, source, [("c", False, 3), ("a", True, 5), ("b", True, 1)])  # b's event is older than what is known
    states(spark, folder, source)
    fresh = KeyedStates(spark, str(folder))  # another process would see the same
    assert sorted(map(tuple, fresh.table().collect())) == [("a", True, 5), ("b", False, 2), ("c", False, 3), ("n", False, 4)]
    states(spark, folder, source)  # nothing new
    assert fresh.table().count() == 4
    with pytest.raises(ValueError):
        KeyedStates(spark, str(folder), forget_ms=5).start(spark.readStream.schema(STATES).parquet(str(source)))


def test_removed_paths_are_forgotten_by_a_timer(spark, tmp_path):
    source, kept = tmp_path / "events", KeyedStates(spark, str(tmp_path / "states"), forget_ms=1)
    add(spark, source, [("stays", False, 1), ("goes", True, 2)])
    query = kept.start(spark.readStream.schema(STATES).parquet(str(source)), once=False)
    try:
        until = time.time() + 90
        while time.time() < until and [r.path for r in kept.table().collect()] != ["stays"]:
            time.sleep(1)
    finally:
        query.stop()
    assert [r.path for r in kept.table().collect()] == ["stays"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path in ("top.gd", "a/x.gd", "a/b/y.gd", "c/z.tscn"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x")
    return root


def batch(reader, start, end):
    """The events of one micro-batch, by path."""
    rows = [r for unit in reader.partitions(start, end) for b in reader.read(unit) for r in b.to_pylist()]
    assert len({r["path"] for r in rows}) == len(rows)
    return {r["path"]: "gone" if r["removed"] else "dir" if r["is_directory"] else "file" for r in rows}


@pytest.mark.parametrize("units", ["1", "3", "64"])
def test_snapshots_tell_every_change_once(tree, tmp_path, units):
    options = {"root": str(tree), "state": str(tmp_path / "state"), "units": units}
    reader = TreeChangesReader(options)
    start, first = reader.initialOffset(), reader.latestOffset()
    assert batch(reader, start, first) == {}
    (tree / "a/x.gd").write_text("longer")
    (tree / "new/deep").mkdir(parents=True)
    (tree / "new/deep/n.gd").write_text("n")
    (tree / "top.gd").unlink()
    second = reader.latestOffset()
    expected = {"a/x.gd": "file", "new": "dir", "new/deep": "dir", "new/deep/n.gd": "file", "top.gd": "gone"}
    assert batch(reader, first, second) == expected
    # a restart before the batch was committed gives it again, whatever happened since
    shutil.rmtree(tree / "c")
    again = TreeChangesReader(options)
    assert batch(again, first, second) == expected
    again.commit(second)
    assert sorted(p for p in os.listdir(tmp_path / "state") if p.startswith("s")) == ["s2"]
    third = again.latestOffset()
    assert third["snapshot"] == 3 and batch(again, second, third) == {"c": "gone", "c/z.tscn": "gone"}
    # a folder becomes a file and a file a folder
    shutil.rmtree(tree / "new")
    (tree / "new").write_text("now a file")
    (tree / "a/x.gd").unlink()
    (tree / "a/x.gd").mkdir()
    fourth = again.latestOffset()
    assert batch(again, third, fourth) == {"new": "file", "new/deep": "gone", "new/deep/n.gd": "gone", "a/x.gd": "dir"}
    assert batch(again, fourth, again.latestOffset()) == {}


def test_existing_files_and_skipped_ones(tree, tmp_path):
    (tree / ".godot/imported").mkdir(parents=True)
    (tree / ".godot/imported/i").write_text("i")
    reader = TreeChangesReader({"root": str(tree), "state": str(tmp_path / "state"), "existing": "true", "hidden": "false"})
    assert set(batch(reader, {"snapshot": 0}, reader.latestOffset())) == {"a", "a/b", "a/b/y.gd", "a/x.gd", "c", "c/z.tscn", "top.gd"}


def wait(watcher, wanted):
    got, until = [], time.time() + 120
    while time.time() < until and not set(wanted) <= set(got):
        got += watcher.drain()
        time.sleep(0.3)
    return got


def first_snapshot(state):
    until = time.time() + 120
    while time.time() < until and not [f for d in (os.listdir(state) if os.path.isdir(state) else []) if d.startswith("s") for f in os.listdir(f"{state}/{d}") if f.endswith(".parquet")]:
        time.sleep(0.2)
    time.sleep(2)


def test_a_watched_tree_across_a_restart(spark, tree, tmp_path):
    project = Project(spark, str(tree), str(tmp_path / "store"))
    project.scan()
    folder = str(tmp_path / "watch")
    project.watch(folder)
    first_snapshot(f"{folder}/snapshots")
    (tree / "a/x.gd").write_text("class_name X\n")
    (tree / "top.gd").unlink()
    got = wait(project.watcher, ["a/x.gd", "top.gd"])
    assert sorted(p for p in got if not p == "a") == ["a/x.gd", "top.gd"]
    project.watcher.stop()
    (tree / "c/more.gd").write_text("extends Node\n")  # while nobody looks
    later = Project(spark, str(tree), str(tmp_path / "store"))
    assert later.watcher.status() == {"running": False, "requires_full_rescan": True, "last_error": ""}
    later.watch(folder)
    try:
        assert sorted(p for p in wait(later.watcher, ["c/more.gd"]) if p != "c") == ["c/more.gd"]  # and nothing that was drained before
        (tree / "c/more.gd").write_text("extends Node2D\n")
        until = time.time() + 120
        while time.time() < until and "c/more.gd" not in later.watcher.dirty_paths():
            time.sleep(0.3)
        row = later.scan_changes().first()
        assert row.status == "completed" and row.entries_deleted == 1 and row.inserted == 1
    finally:
        later.watcher.stop()
    assert {r.path for r in later.store.table("files").where("not is_deleted").collect()} == {"a", "a/b", "a/b/y.gd", "a/x.gd", "c", "c/more.gd", "c/z.tscn"}


def test_a_drained_batch_is_not_given_again(spark, tmp_path):
    events = spark.createDataFrame([("res://a/../b.gd", False, False), ("b.gd", True, False), ("", False, True)], EVENTS)
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    first = Watcher(spark)
    assert first.drain() == [] and first.dirty_paths() == []
    first.start(stream(), str(tmp_path / "w"))
    first.query.processAllAvailable()
    assert first.dirty_paths() == ["b.gd"] == first.drain() and first.drain() == []
    first.stop()
    second = Watcher(spark)
    second.start(stream(), str(tmp_path / "w"))
    second.query.processAllAvailable()
    assert second.drain() == []
    spark.createDataFrame([("c.gd", False, False)], EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    second.query.processAllAvailable()
    second.stop()
    third = Watcher(spark)  # what waits survives too
    third.folder = second.folder
    assert third.drain() == ["c.gd"]
    assert not [f for f in os.listdir(tmp_path / "w/events") if f.startswith("batch=")]


def test_follow_hands_on_each_batch(spark, tree, tmp_path):
    spark.createDataFrame([("a/x.gd", False, False)], EVENTS).write.parquet(str(tmp_path / "in"))
    seen = []
    follow(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), seen.append, str(tmp_path / "c")).awaitTermination()
    assert seen == [["a/x.gd"]]
    assert tree_changes(spark, str(tree), str(tmp_path / "s")).isStreaming
