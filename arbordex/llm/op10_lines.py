"""Operator 10, line dedup: levelled sorted runs of line hashes.

A run is a table (hash, n), bucketed and sorted by hash: in how many documents of the batches behind it a line key occurs. A new
batch is summed, merge-anti-joined with the keys that a run has already settled (found in enough documents), and adds the rest as a
run of level 0. FANOUT runs of a level are merged into one of the next, two sorted runs at a time. Batches and runs share their
buckets, so joins and merges need no exchange; a batch is exchanged once, when it is summed. At the end all levels are merged, and
the keys found in at least `documents` documents are common.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased; keys are compared by 64-bit hashes. A
document counts once for a key however often it has it. A key of fewer than `points` code points is never dropped. Null or empty
text: one empty line, whose key is empty. Lines keep their order and their other bytes. Rows that share a doc_id, or have none, are
documents of their own. Other columns may have any name. BROADCAST_KEYS chooses between two ways to the same result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.tables import bounded, checkpointed, dropped, mapped, partitions, saved, table

LEAST_DOCUMENTS = 10
LEAST_POINTS = 1
FANOUT = 2
#: Batches that a table of files arrives as, unless BATCH_FILES asks for more.
BATCHES = 4
BATCH_FILES = 20_000
#: Hashes that a broadcast may hold (32 MB); with more common lines than that, lines and runs are joined instead.
BROADCAST_KEYS = 4_000_000
_STRIP = b" \t\n\r\x0b\x0c"
_hash = xxhash.xxh3_64_intdigest


def keys(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines of a text and the 64-bit hash of each line's key."""
    lines = text.split(b"\n")
    return lines, [_hash(x.strip(_STRIP)) for x in text.lower().split(b"\n")]


def batch_counts(df: DataFrame, text: str, points: int = LEAST_POINTS) -> DataFrame:
    """(hash, n) of each line key of a batch of documents; summed in each task before the shuffle."""

    def run(batches):
        short = _hash(b"")
        for b in batches:
            found: list[int] = []
            for t in b.column(0).cast(pa.large_binary()).to_pylist():
                t = t or b""
                if points > 1:
                    found += {_hash(k) for x in t.lower().split(b"\n") if len((k := x.strip(_STRIP)).decode("utf-8", "replace")) >= points}
                else:
                    found += set(keys(t)[1])
            hashes, n = np.unique(np.array(found, np.uint64), return_counts=True)
            keep = (hashes != short) | (points < 1)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["hash", "n"])

    return mapped(df.select(df[text].alias("text")), run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class LineRuns:
    """Runs as bucketed tables in the folder that the cluster shares; `close` drops them, also after a failure."""

    def __init__(self, spark: SparkSession, documents: int = LEAST_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.documents, self.fanout, self.buckets = spark, documents, fanout, partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0
        self.tables: set[str] = set()

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"{self.name}_{level}_{self.made}"
        self.made += 1
        saved(run, name, "hash", self.buckets)
        self.tables.add(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _merge(self, names: list[str], level: int) -> None:
        """Runs become one, two at a time: a full outer merge join of sorted buckets."""
        while len(names) > 1:
            a, b = (self.spark.table(n).withColumnRenamed("n", f"n{i}") for i, n in enumerate(names[:2]))
            both = a.join(b.hint("merge"), "hash", "full").select("hash", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))
            self._write(both, level)
            self._drop(names[:2])
            names = [*names[2:], self.levels[level].pop()]
        self.levels[level] += names

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The batch's keys that no run has found in enough documents yet."""
        for name in self._runs():
            counts = counts.join(self.spark.table(name).where(F.col("n") >= self.documents).select("hash").hint("merge"), "hash", "left_anti")
        return counts

    def new_lines(self, counts: DataFrame) -> DataFrame:
        """The batch's keys that no run has."""
        for name in self._runs():
            counts = counts.join(self.spark.table(name).select("hash").hint("merge"), "hash", "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Keep a batch's unsettled counts as a run; a level with `fanout` runs becomes one run of the next level."""
        self._write(self.unsettled(counts), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self._merge(old, level + 1)
            level += 1

    def seen(self) -> DataFrame:
        """(hash, n) over all batches so far, n of settled keys at least `documents`; all levels become one run."""
        names = self._runs()
        if not names:
            return self.spark.createDataFrame([], "hash long, n long")
        top = len(self.levels) - 1
        self.levels = [[] for _ in self.levels]
        self._merge(names, top)
        return self.spark.table(self.levels[top][0])

    def _drop(self, names: list[str]) -> None:
        dropped(self.spark, *names)
        self.tables -= set(names)

    def close(self) -> None:
        self._drop(sorted(self.tables))
        self.levels = [[]]

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def common_hashes(runs: LineRuns, most: int = BROADCAST_KEYS) -> tuple[DataFrame | None, np.ndarray | None]:
    """The hashes of common lines: as an array if there are no more than `most`, else as a table. The runs are dropped."""
    common = runs.seen().where(F.col("n") >= runs.documents).select("hash")
    found = common.limit(most + 1).toArrow()["hash"].to_numpy()
    held = None if len(found) <= most else checkpointed(common)
    runs.close()
    return held, np.sort(found) if held is None else None


def _kept(text: bytes, common: np.ndarray) -> tuple[int, list[bytes]]:
    lines, hashed = keys(text)
    at = np.searchsorted(common, own := np.array(hashed, np.uint64).view(np.int64))
    drop = common[np.minimum(at, len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
    return len(lines), [x for x, d in zip(lines, drop.tolist()) if not d] if drop.any() else lines


def _cleaned(df: DataFrame, text: str, runs: LineRuns, most: int) -> tuple[DataFrame, dict]:
    """(text, c0, c1 ..., n_lines, n_dropped, kept_text), and the columns of df by name. Up to `most` common hashes are broadcast;
    beyond, the lines' hashes are joined with them and each text gets the list of its own common hashes."""
    common, array = common_hashes(runs, most)
    own = [c for c in df.columns if c != text]
    source = df.select(df[text].alias("text"), *[df[c].alias(f"c{i}") for i, c in enumerate(own)])
    if array is not None:
        shared = df.sparkSession.sparkContext.broadcast(array)
    else:
        shared = None
        source = source.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        hits = mapped(source.select("text", "digest"), _line_hashes, "hash long, digest string").join(common, "hash", "left_semi").groupBy("digest").agg(F.collect_set("hash").alias("common"))
        source = source.join(hits, "digest", "left").drop("digest")
    kinds = dict(df.dtypes)
    schema = ", ".join(["text string", *(f"c{i} {kinds[c]}" for i, c in enumerate(own)), "n_lines long", "n_dropped long", "kept_text string"])
    n = len(own) + 1

    def run(batches):
        for b in batches:
            out = []
            extra = b.column(n).to_pylist() if shared is None else None
            for i, t in enumerate(b.column(0).cast(pa.large_binary()).to_pylist()):
                mine = shared.value if shared is not None else np.sort(np.array(extra[i] or [], np.int64))
                count, kept = _kept(t or b"", mine)
                out.append((count, count - len(kept), b"\n".join(kept)))
            counts, dropped, kept_texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())], names)

    names = ["text", *(f"c{i}" for i in range(len(own))), "n_lines", "n_dropped", "kept_text"]
    return mapped(source, run, schema), {c: F.col(f"c{i}") for i, c in enumerate(own)} | {text: F.col("text")}


def clean(df: DataFrame, text: str, runs: LineRuns, most: int = BROADCAST_KEYS) -> DataFrame:
    """df with n_lines, n_dropped and kept_text added (in place of columns of these names); the runs are used up."""
    made, columns = _cleaned(df, text, runs, most)
    added = ("n_lines", "n_dropped", "kept_text")
    return made.select(*[columns[c].alias(c) for c in df.columns if c not in added], *added)


def _line_hashes(batches):
    for b in batches:
        hashes, digests = [], []
        for t, d in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist()):
            own = set(keys(t or b"")[1])
            hashes += own
            digests += [d] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(digests, pa.string())], ["hash", "digest"])


def drop_common(df: DataFrame, text: str, length: str | None = None, documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """df with its common lines removed from `text` and `length` set to the new number of code points; null texts stay null. The rows
    arrive as BATCHES batches."""
    with LineRuns(df.sparkSession, documents) as runs:
        for batch in shares(df.select(df[text].alias("text")), BATCHES):
            runs.add(batch_counts(batch, "text"))
        made, columns = _cleaned(df, text, runs, BROADCAST_KEYS)
    changed = F.col("n_dropped") > 0
    columns = columns | {text: F.when(changed, F.col("kept_text")).otherwise(columns[text])}
    if length in columns:
        columns[length] = F.when(changed, F.char_length("kept_text")).otherwise(columns[length]).cast(dict(df.dtypes)[length])
    return made.select(*[columns[c].alias(c) for c in df.columns])


def shares(df: DataFrame, n: int) -> list[DataFrame]:
    """df as n batches, by a hash of its rows."""
    place = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return [df.where(place == i) for i in range(n)] if n > 1 else [df]


def file_batches(spark: SparkSession, df: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """A table of files as batches of at most BATCH_FILES whole files. A table of fewer files than batches arrives by shares of its
    rows; one without files is one empty batch."""
    files = sorted(df.inputFiles())
    if 0 < len(files) < batches:
        return shares(df, batches)
    size = min(BATCH_FILES, max(1, -(-len(files) // batches)))
    return [spark.read.schema(df.schema).parquet(*files[first : first + size]) for first in range(0, len(files), size)] or [df]


def op10_lines(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> DataFrame:
    """`documents` arrives as a few batches of files or rows, each of which meets the runs and adds its own."""
    bounded(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with LineRuns(spark) as runs:
        for batch in file_batches(spark, docs, batches):
            runs.add(batch_counts(batch, "text"))
        found = clean(docs, "text", runs)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
), common AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM lines GROUP BY doc_id
"""
