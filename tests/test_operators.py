

from pyspark.sql import functions as F

from arbordex.operators import graph, inventory, merge, resolve, snapshot
from arbordex.operators.lineage import numbered
from arbordex.streaming.changes import EVENTS, follow


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dirty_reasons(spark):
    old = "path string, kind string, size_bytes long, modified_ns long, file_identity string, parser_version int, scene_parser_version int, parse_status string"
    new = "path string, kind string, size_bytes long, modified_ns long, file_identity string"
    had = [("a", "file", 1, 1, "i", 2, 1, ""), ("b", "file", 1, 1, "i", 2, 1, ""), ("c", "file", 1, 1, "", 2, 1, ""), ("d", "directory", 0, 1, "", 2, 1, ""), ("e", "file", 1, 1, "i", 1, 1, ""), ("f", "file", 1, 1, "i", 2, 1, "io_error"), ("g.tscn", "file", 1, 1, "i", 2, 0, "")]
    has = [("a", "file", 1, 1, "i"), ("b", "file", 2, 1, "i"), ("c", "file", 1, 1, "x"), ("d", "directory", 0, 9, ""), ("e", "file", 1, 1, "i"), ("f", "file", 1, 1, "i"), ("g.tscn", "file", 1, 1, "i"), ("n", "file", 1, 1, "")]
    scan, known = spark.createDataFrame(has, new), spark.createDataFrame(had, old)
    got = lambda **k: {r.path: r.dirty_reason for r in snapshot.diff(scan, known, versions={"parser": 2}, scene_version=1, **k).collect()}
    assert got() == {"a": "clean", "b": "size_changed", "c": "clean", "d": "clean", "e": "parser_version_changed", "f": "prior_parse_failed_retry", "g.tscn": "scene_parser_version_changed", "n": "new_path"}
    assert got(force=True)["n"] == "new_path" and got(force=True)["a"] == "force_rescan"
    assert got(dirty_paths=["b"])["b"] == "watcher_invalidated" and got(dirty_paths=["b"])["e"] == "clean"


def test_page_is_clamped(spark):
    df = spark.range(600).withColumn("path", F.format_string("%05d", "id")).withColumn("name", F.col("path"))
    assert inventory.page(df, inventory.file_order("x"), -5, 501).count() == 500
    assert inventory.page(df, inventory.file_order("x"), 590, 100).count() == 10
    assert inventory.page(df, inventory.file_order("x"), 0, 0).count() == 0


def test_cycles(spark):
    def found(*pairs):
        df = spark.createDataFrame(list(pairs), "src long, dst long")
        return [(r.cycle_path, r.hop_count) for r in graph.cycles(df).collect()]

    assert found((1, 1), (1, 1)) == [("1,1,1", 2)]
    assert found((1, 2), (2, 1), (2, 1), (2, 3)) == [("1,2,1", 2), ("2,1,2", 2)]
    assert found((1, 2), (2, 3), (3, 1)) == [("1,2,3,1", 3), ("2,3,1,2", 3), ("3,1,2,3", 3)]
    assert found((1, 2), (2, None)) == []
    # a chain that leads nowhere is trimmed however long, and short cycles fill a report before long ones are walked
    long = [(k, k + 1) for k in range(100, 112)] + [(112, 100)]
    many = [e for k in range(1000, 1300, 2) for e in ((k, k + 1), (k + 1, k))]
    assert len(found(*long)) == 13 and found(*long, *[(k, k + 1) for k in range(500, 580)])[0][1] == 13
    assert len(found(*many, *long)) == 256 and {h for _, h in found(*many, *long)} == {2}


def test_slice(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1), (2, None)], "src long, dst long")
    assert rows(graph.slice_from(edges, 1, 0)) == [(1, 2)]
    assert len(rows_null(graph.slice_from(edges, 1, 1))) == 3
    assert len(rows_null(graph.slice_from(edges, 1, 17))) == 4
    assert graph.slice_from(edges, 77, 3).count() == 0


def rows_null(df):
    return df.collect()


def test_attachment_fill_survives_unknown_and_repeated_ids(spark):
    a = spark.createDataFrame([(1, "r", "", ""), (1, "missing", "", ""), (1, "r", "own", "u")], "scene_id long, resource_id string, script_path string, script_uid string")
    r = spark.createDataFrame([(1, "r", 0, "first", "u1"), (1, "r", 1, "last", "u2")], "scene_id long, resource_id string, slot long, path string, uid string")
    assert sorted((x.resource_id, x.script_path, x.script_uid) for x in resolve.fill_attachments(a, r).collect()) == [("missing", "", ""), ("r", "last", "u2"), ("r", "own", "u")]


def test_numbered_and_registry(spark):
    got = rows(numbered(spark.createDataFrame([(c,) for c in "dbca"], "path string"), "path", 10))
    assert got == [("a", 10), ("b", 11), ("c", 12), ("d", 13)]
    classes = spark.createDataFrame([("C", "z.gd"), ("C", "a.gd"), ("D", "d.gd")], "class_name string, path string")
    assert rows(merge.class_registry(classes)) == [("C", "z.gd"), ("D", "d.gd")]


def test_change_stream(spark, tmp_path):
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    (feed / "1.json").write_text('{"path":"res://b.gd","removed":false,"is_directory":false}\n{"path":"./a//c.gd","removed":true,"is_directory":false}\n{"path":"b.gd","removed":false,"is_directory":false}\n')
    follow(spark.readStream.schema(EVENTS).json(str(feed)), seen.append, str(tmp_path / "offsets")).awaitTermination()
    assert seen == [["a/c.gd", "b.gd"]]


def test_many_dirty_paths_are_rows(spark, monkeypatch):
    columns = "path string, kind string, size_bytes long, modified_ns long, file_identity string"
    scan = spark.createDataFrame([(p, "file", 1, 1, "") for p in ("a/b/c.gd", "a/bc.gd", "d.gd", "new.gd", "e/f.gd")], columns)
    old = spark.createDataFrame([(p, "file", 2, 1, "", "x") for p in ("a/b/c.gd", "a/bc.gd", "d.gd", "e/f.gd")], f"{columns}, parse_status string")
    found = lambda paths: {r.path: r.dirty_reason for r in snapshot.diff(scan, old, dirty_paths=paths).collect()}
    few = found(["a/b", "d.gd", "none"])
    assert few == {"a/b/c.gd": "watcher_invalidated", "a/bc.gd": "clean", "d.gd": "watcher_invalidated", "e/f.gd": "clean", "new.gd": "new_path"}
    assert found(["a/b", "d.gd", *(f"n{i}" for i in range(3000))]) == few
    plan = snapshot.diff(scan, old, dirty_paths=["a/b", *(f"n{i}" for i in range(3000))])._jdf.queryExecution().optimizedPlan().toString()
    assert "n2999" not in plan
