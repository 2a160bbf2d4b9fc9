"""Where the operators' queries find their tables, and how their Python functions run over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import release

#: Settings that bound what one Arrow batch and one Parquet batch hold where texts are long; (setting, Spark's default, ours).
BATCHES = (
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "4000"),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),
)

_caches: list[Callable[[], None]] = []


def forgets(cached):
    """A cached function whose values go when a task ends, as its worker may wait idle or run other stages next."""
    _caches.append(cached.cache_clear)
    return cached


def bounded(spark: SparkSession) -> None:
    """Bound the session's batches, except where it has settings of its own."""
    for name, default, ours in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def _tidy() -> None:
    for forget in _caches:
        forget()
    release()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with bounded batches; a task gives its memory back when it ends, also where it fails or stops early."""
    bounded(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _tidy()

    task.__name__ = run.__name__  # what plans show
    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row_each(df: DataFrame, key: str) -> bool:
    """Whether every row has an id and no two rows share one: a job that reads the ids alone."""
    ids = df.select(df[key].cast("long").alias("id")).groupBy("id").count()
    return ids.where("id is null or count > 1").isEmpty()


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc_id, text): a null text is empty. `row` tells rows apart: it is the id where all rows have ids of their own, which
    shuffles best, else a hash of id and text, which equal rows share."""
    doc_id, filled = df[key].cast("long"), F.coalesce(df[text], F.lit(""))
    row = doc_id if one_row_each(df, key) else F.xxhash64(doc_id, filled)
    return df.select(row.alias("row"), doc_id.alias("doc_id"), filled.alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one only a local session gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/arbordex-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table that is dealt and sorted by a column. Its files lie in the shared folder, not in the session's warehouse, which may
    be a folder of one machine; a write that fails leaves nothing behind."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/{name}"
    try:
        df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", where).saveAsTable(name)
    except BaseException:
        dropped(spark, name)
        raise
    return spark.table(name)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """(df as a table that is dealt and sorted by a column, its name); joins by the column need no exchange of it."""
    name, n = f"arbordex_{uuid.uuid4().hex}", partitions(df.sparkSession)
    return saved(df.repartition(n, key), name, key, n), name


def dropped(spark: SparkSession, *names: str) -> None:
    """Remove tables that `saved` made, and their files."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        deleted(spark, f"{shared_dir(spark).rstrip('/')}/{name}")


def sampled(df: DataFrame, key: str, text: str, most: int, label: str | None = None) -> DataFrame:
    """(label, text) of at most `most` different rows of each label (or of all): those whose hash of id and text is smallest.
    Equal rows are one, so rows that share an id or have none can't swell the sample. Bounds of the labels, which the driver counts,
    are told to all tasks; only the rows of the sample, and about as many more, are moved."""
    spark, named = df.sparkSession, F.lit("") if label is None else df[label]
    rows = df.select(named.alias("label"), df[text].alias("text"), F.xxhash64(df[key], df[text]).alias("hash"))

    def below(df: DataFrame, bounds: dict[str, int]) -> DataFrame:
        if label is None:
            return df.where(F.col("hash") <= F.lit(bounds.get("", 0)))
        told = spark.createDataFrame(list(bounds.items()), "label string, bound long")
        return df.join(F.broadcast(told), "label").where("hash <= bound").drop("bound")

    sizes = {"": df.count()} if label is None else {r[0]: r[1] for r in rows.where("label is not null").groupBy("label").count().collect()}
    # hashes up to twice the share that is wanted, then the exact bound among them
    low, span = -(1 << 63), 1 << 64
    near = below(rows, {k: low + min(span - 1, 2 * most * span // max(n, 1)) for k, n in sizes.items()})
    near = checkpointed(near.groupBy("label", "hash").agg(F.first("text").alias("text")))
    found = near.select("label", "hash").toArrow().to_pandas().groupby("label")["hash"]
    return below(near, {k: int(h.nsmallest(most).max()) for k, h in found}).select("label", "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deleted(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
