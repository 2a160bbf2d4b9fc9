import corpus_pipeline
import pytest

from arbordex.llm import registry
from arbordex.llm.tables import checkpointed


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "secrets", "packing"]
    assert [k for k in registry.QUERIES if k.startswith("op")] == sorted((k for k in registry.QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert len(registry.QUERIES) == 14 and set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("extra", ["hash", "row", "c0", "n_lines", "fate"])
def test_stages_keep_columns_and_clean_documents(spark, docs, extra):
    plain = docs.withColumn(extra, docs["doc_id"] * 2)
    kept = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = checkpointed(stage(spark, kept, "unused"))
        assert kept.columns == plain.columns
    clean = {r.doc_id: r.text for r in plain.where("doc_id < 180").collect()}
    assert {r.doc_id: r.text for r in kept.where("doc_id < 180").collect()} == clean
    assert kept.count() == kept.select("doc_id").distinct().count()  # repeated rows stay once
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "unused").select("doc_id").distinct().count() == kept.count()


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 60
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
