"""What the lists show: rows with the fallbacks of their empty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(column: str, *others: str) -> Column:
    """A text column, or the first of the others that is not empty; null is empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (column, *others)], F.lit(""))


def engine_path(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "").otherwise(F.concat(F.lit("res://"), column))


def symbol_rows(df: DataFrame) -> DataFrame:
    """The name falls back to the symbol's name, flags of 0 to `symbol_flags` where there are any."""
    flags = F.when(F.col("flags") == 0, F.col("symbol_flags")).otherwise(F.col("flags")) if "symbol_flags" in df.columns else F.col("flags")
    return df.withColumn("name", filled("name", "symbol_name")).withColumn("flags", flags)


def edge_rows(df: DataFrame) -> DataFrame:
    """Dependencies and references: targets as engine paths, confidence as a fraction, null texts empty. An owner of 0 or less falls
    back to `source_file_id` where there is one."""
    out = df.withColumn("target_project_path", filled("target_path")).withColumn("target_path", engine_path("target_path"))
    out = out.withColumn("confidence", F.col("confidence_milli") / 1000.0)
    for c in ("target_class", "target_name", "target_uid", "reference_text"):
        out = out.withColumn(c, filled(c))
    if "source_file_id" in df.columns:
        out = out.withColumn("file_id", F.when(F.coalesce("file_id", F.lit(0)) <= 0, F.col("source_file_id")).otherwise(F.col("file_id")))
    return out


def attachment_rows(df: DataFrame) -> DataFrame:
    """The resource's slot falls back to its id, its path to the script's, and its uid to the script's."""
    known = df.columns
    slot = filled("resource_slot", "resource_id") if "resource_slot" in known else filled("resource_id")
    path = filled("resource_path", "script_path") if "resource_path" in known else filled("script_path")
    uid = filled("resource_uid", "script_uid") if "resource_uid" in known else filled("script_uid")
    out = df.withColumns({"resource_slot": slot, "resource_path": path, "resource_uid": uid})
    return out.withColumn("script_project_path", filled("script_path")).withColumn("script_path", engine_path("script_path"))
