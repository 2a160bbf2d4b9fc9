import os

import pytest

import __spark_entry__ as entry
from arbordex.plans import catalog

DATA = "/root/testdata/sf0.001"
SOME = """files_page_path files_page_type files_page_laid files_page_laid_search files_filter_search files_filter_parent classify_files type_histogram legacy_taxonomy unknowns normalize_path snapshot_diff merge_upsert
best_match_source_symbol asof_enclosing_symbol target_symbol dependency_cycles graph_slice_d2 attachment_fill parse_gdscript stream_dirty_batches project_files project_classes
project_references project_attachments project_doc_gaps project_rescan project_symbols_sql document_symbols_sql taxonomy_every_rule list_projects""".split()


def test_every_name_is_registered_with_sql():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) <= set(entry.queries())
    assert len(catalog.QUERIES) >= 80


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    found, expected = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.ORACLE[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)

    import pandas as pd

    def shown(df):
        whole = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
        return sorted(tuple(str(whole(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False))

    assert shown(found) == shown(expected)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_symbols_in_sql_need_no_scan(spark, monkeypatch):
    from arbordex.plans import trees

    def scan(*_, **__):
        raise AssertionError("scanned")

    monkeypatch.setattr(trees, "_scanned", {})
    monkeypatch.setattr(trees.Project, "scan", scan)
    assert catalog.QUERIES["project_symbols_sql"](spark, DATA).count() == spark.read.parquet(f"{DATA}/supplier.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_a_tree_is_changed_by_tasks(spark, monkeypatch):
    def walk(*_, **__):
        raise AssertionError("walked on the driver")

    monkeypatch.setattr(os, "walk", walk)
    keys = [r[0] for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()]
    found = catalog.QUERIES["project_rescan"](spark, DATA).first()
    assert (found.entries_deleted, found.updated) == (sum(k % 10 == 3 for k in keys), sum(k % 10 == 4 for k in keys))
    assert found.inserted == found.dirs_seen == found.scripts_parsed - found.updated
