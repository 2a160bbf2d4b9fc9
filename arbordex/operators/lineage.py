"""Cutting the lineage of loops, so that plans stay small and lost executors cost no recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Without one only a local session gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return where or "/tmp/arbordex-checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """df with `id`: start, start + 1, … in the order of a column. Rows are dealt into ranges and numbered within each; only one
    row for each range meets in one place."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    dealt = kept(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_place") + F.lit(start - 1)).cast("long").alias("id"))
