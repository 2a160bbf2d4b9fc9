"""The tree source: what filters save, and that they never change the result."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from arbordex.sources import scripts, tree
from arbordex.sources.tree import TreeReader

FILES = {
    "top.gd": "t", "a/x.gd": "xx", "a/y.CS": "yyy", "a/.hidden.gd": "h", "a/b/z.tscn": "zzzz", "ab/q.gd": "qqqqq", "ab/no_extension": "n", "ab/ends.": "e", "deep/1/2/3/4.gd": "four",
    ".godot/imported/i.gd": "i", "big.gd": "b" * 100_000,
}


@pytest.fixture
def root(tmp_path):
    for path, content in FILES.items():
        (tmp_path / "t" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / path).write_text(content)
    (tmp_path / "t" / "link.gd").symlink_to("top.gd")
    return str(tmp_path / "t")


def read(monkeypatch, root, filters, **options):
    """(paths given, files opened, folders listed, filters left to Spark)."""
    opened, listed, plain, scan = [], [], tree.read_file, os.scandir
    monkeypatch.setattr(tree, "read_file", lambda r, p, n: (opened.append(p), plain(r, p, n))[1])
    monkeypatch.setattr(os, "scandir", lambda p: (listed.append(str(p)), scan(p))[1])
    reader = TreeReader({"root": root, **options})
    left = list(reader.pushFilters(filters))
    units = reader.partitions()
    listed.clear()
    rows = [r["path"] for u in units for b in reader.read(u) for r in b.to_pylist()]
    monkeypatch.undo()
    return sorted(rows), sorted(opened), [os.path.relpath(p, root) for p in listed], left


SEEN = sorted([p for p in FILES if not p.startswith(".godot/imported")] + ["link.gd"])


@pytest.mark.parametrize("units", ["1", "4", "64"])
def test_filters_save_reading(monkeypatch, root, units):
    every, opened, _, _ = read(monkeypatch, root, [], units=units)
    assert every == opened == SEEN
    assert read(monkeypatch, root, [EqualTo(("path",), "a/x.gd")], units=units) == (["a/x.gd"], ["a/x.gd"], [], [])
    some, opened, listed, _ = read(monkeypatch, root, [In(("path",), ["a/x.gd", "none.gd", "a", "a//x.gd", "../t/top.gd", "/a/x.gd", ".godot/imported/i.gd", ""])], units=units)
    assert some == opened == ["a/x.gd"] and not listed
    some, opened, _, _ = read(monkeypatch, root, [EqualTo(("extension",), ".cs")], units=units)
    assert some == opened == ["a/y.CS"]
    some, opened, _, left = read(monkeypatch, root, [GreaterThan(("size_bytes",), 4), LessThanOrEqual(("size_bytes",), 5)], units=units)
    assert some == opened == ["ab/q.gd"] and not left
    for prefix in ("a/", "a", "a/b/z", "ab/q", "deep/1/2/", "zz", "top"):
        assert read(monkeypatch, root, [StringStartsWith(("path",), prefix)], units=units)[0] == [p for p in SEEN if p.startswith(prefix)]
    for folder in ("a", "ab", "a/b", "deep/1/2/3", "deep/1", "zz"):
        assert read(monkeypatch, root, [EqualTo(("parent_path",), folder)], units=units)[0] == [p for p in SEEN if p.rpartition("/")[0] == folder]
    assert "a" not in read(monkeypatch, root, [StringStartsWith(("path",), "deep/1/2/")], units="4")[2]
    other = EqualTo(("name",), "x.gd")
    assert read(monkeypatch, root, [other], units=units)[3] == [other]
    assert read(monkeypatch, root, [], units=units, hidden="false")[0] == [p for p in SEEN if "/." not in p]
    assert read(monkeypatch, root, [], units=units, content="false")[1] == []


def test_filters_reach_the_source(spark, root):
    files = tree.tree(spark, root)
    plain = {(r.path, r.extension, r.size_bytes, bytes(r.content)) for r in files.collect()}
    assert {p for p, *_ in plain} == set(SEEN) and ("ab/ends.", "", 1, b"e") in plain and ("link.gd", ".gd", 6, b"t") in plain
    for condition in ("path = 'a/x.gd'", "path IN ('a/x.gd', 'top.gd', 'gone')", "path LIKE 'a/%' AND extension = '.gd'", "parent_path = 'ab' OR size_bytes > 4", "parent_path = 'ab' AND name LIKE 'q%'", "parent_path IS NULL", "extension IN ('.gd', '.cs') AND size_bytes BETWEEN 2 AND 3", "path = 'a/x.gd' AND path = 'top.gd'"):
        expected = {r.path for r in spark.createDataFrame([(p, p.rpartition("/")[0] or None, p.rpartition("/")[2], e, n) for p, e, n, _ in plain], "path string, parent_path string, name string, extension string, size_bytes long").where(condition).collect()}
        assert {r.path for r in files.where(condition).collect()} == expected, condition
    plan = files.where("path = 'a/x.gd'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_reads_stop_at_the_limit(spark, root):
    paths = spark.createDataFrame([("big.gd",), ("a/x.gd",), ("gone.gd",), ("a",)], "path string")
    got = {r.path: r.content for r in tree.opened(tree.dealt(paths), root, limit=1000).collect()}
    assert len(got["big.gd"]) == 1001 and got["gone.gd"] is None and got["a"] is None and bytes(got["a/x.gd"]) == b"xx"
    header = tree.tree(spark, root, limit=scripts.TIERS["header"].size).where("extension = '.gd'")
    parsed = scripts.parse_scripts(header, "header").where(F.col("path") == "big.gd").first()
    assert parsed.bytes_read == 64 << 10 and parsed.limit_exceeded


def test_short_paths_are_many_tasks(spark):
    """A thousand paths are a few KB, which Spark alone would give to one task."""
    tasks = lambda df: df.select(F.spark_partition_id().alias("t")).distinct().count()
    paths = spark.range(1000).selectExpr("concat('p', id) AS path")
    assert tasks(tree.dealt(paths)) == 16
    assert tasks(tree.dealt(paths, 100_000)) == 16 and tasks(tree.dealt(paths, 100)) == 3 and tasks(tree.dealt(paths, 0)) == 1
