"""One-row summaries; each table is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def script_summary(file_id: int, symbols: DataFrame, docs: DataFrame, refs: DataFrame) -> DataFrame:
    s = symbols.where(F.col("file_id") == file_id).agg(
        F.count("*").alias("symbols"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "property").alias("properties"), F.count_if(F.col("kind") == "parameter").alias("parameters")
    )
    d = docs.where(F.col("file_id") == file_id).agg(F.count("*").alias("doc_comments"))
    r = refs.where(F.col("file_id") == file_id).agg(F.count("*").alias("refs"), F.count_if("is_unresolved").alias("unresolved"), F.count_if("is_dynamic").alias("dynamic"))
    one = F.lit(1).alias("_one")
    return s.select("*", one).join(d.select("*", one), "_one").join(r.select("*", one), "_one").drop("_one")


def resolution_counts(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count("*").alias("refs"), F.count_if("is_resolved").alias("resolved"), F.count_if("is_unresolved").alias("unresolved"), F.count_if("is_dynamic").alias("dynamic"))
