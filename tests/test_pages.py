"""Pages of orders on disk against pages of a sort."""

import os

import pytest
from pyspark.sql import functions as F

from arbordex import project as module
from arbordex.operators import inventory, pages
from arbordex.project import SORTS, Project


def rows(spark, n):
    df = spark.range(n).withColumn("path", F.concat(F.md5(F.col("id").cast("string")), F.lit(".gd"))).withColumn("name", F.concat(F.lit("n"), F.col("id") % 7))
    return df.withColumns({"modified_ns": (F.col("id") * 7919 % 1013).cast("long"), "file_type": F.when(F.col("id") % 3 > 0, F.lit("Script"))})


@pytest.mark.parametrize(("key", "bits"), [("path", 2), ("name", 16), ("modified_time", 2), ("file_type", 2)])
def test_pages_equal_those_of_a_sort(spark, tmp_path, monkeypatch, key, bits):
    monkeypatch.setattr(pages, "BLOCK_BITS", bits)  # blocks of four rows, so pages span many
    df, order, folder = rows(spark, 2000), inventory.file_order(key), str(tmp_path / "laid")
    pages.lay(df.repartition(5), order, folder)
    for keep in (None, lambda d: d.where("file_type = 'Script'"), lambda d: d.where("id % 251 = 0")):
        whole = (keep(df) if keep else df).orderBy(*order).collect()
        for offset, limit in ((-4, 501), (3, 1), (1300, 400), (1990, 100), (2000, 5), (7, 0)):
            expected = whole[max(offset, 0) :][: min(limit, 500)]
            assert pages.page(spark, folder, offset, limit, keep).collect() == expected, (offset, limit)


def test_an_empty_list_has_empty_pages(spark, tmp_path):
    pages.lay(rows(spark, 0), inventory.file_order("path"), str(tmp_path / "laid"))
    found = pages.page(spark, str(tmp_path / "laid"))
    assert found.collect() == [] and found.columns == ["id", "path", "name", "modified_ns", "file_type"]


def test_a_page_reads_few_rows(spark, tmp_path):
    """Of 400,000 rows in order the scan gives a page's own rows and what shares their pages of the file."""
    folder = str(tmp_path / "laid")
    pages.lay(spark.range(400_000).withColumn("path", F.format_string("%08d", "id")), inventory.file_order("path"), folder)
    found = pages.page(spark, folder, 310_000, 500)
    assert [r.id for r in found.collect()] == list(range(310_000, 310_500))
    plan = found._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 500 <= read <= 40_000


def test_lists_of_a_project(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "NEAR", 5)  # pages under a filter come from orders too
    root, used = str(tmp_path / "tree"), []
    os.makedirs(f"{root}/d")
    for i in range(30):
        with open(f"{root}/d/s{i}.gd" if i % 2 else f"{root}/S{i}.txt", "w") as f:
            f.write(f"class_name C{i}\nextends {'Node' if i % 3 else 'Resource'}\n")
        os.utime(f.name, (i % 5, i % 5))
    p, page = Project(spark, root, str(tmp_path / "store")), pages.page
    p.scan()
    asked = [
        (p.files_page, ("modified_time", "other"), ({"search": "S1"}, {"is_directory": False}, {"include_deleted": True}, {"parent_id": 0}, {"search": ""})),
        (p.classes_page, ("base_type",), ({}, {"search": "c1"})),
    ]

    def every():
        return [f(at, 6, sort, **q).collect() for f, sorts, queries in asked for sort in sorts for q in queries for at in (0, 4)]

    sorted_anew = every()
    p.lay_pages()
    monkeypatch.setattr(pages, "page", lambda *a: used.append(a) or page(*a))
    assert every() == sorted_anew and len(used) == 2 * (2 * 4 + 2)
    number, before = p.store.current()["number"], sorted(os.listdir(p.store.folder))
    p.lay_pages("name")  # they are there
    assert (p.store.current()["number"], sorted(os.listdir(p.store.folder))) == (number, before)
    os.remove(f"{root}/d/s1.gd")
    p.scan()  # ends the orders of the tables that it wrote
    used.clear()
    assert "res://d/s1.gd" not in {r.path for r in p.files_page().collect()} and "C1" not in {r.class_name for r in p.classes_page().collect()}
    assert not used
    p.lay_pages("path", "class_name")
    assert "res://d/s1.gd" not in {r.path for r in p.files_page().collect()} and "C1" not in {r.class_name for r in p.classes_page().collect()}
    assert len(used) == 2
