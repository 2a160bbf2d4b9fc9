"""Shuffles of many small records as packed columns.

A mapper turns texts into numpy records, each with a bucket; the records of a batch that go to one bucket travel as one row
(bucket, payload). Spark sorts these rows by bucket, and a reducer gets all records of one bucket as columns, one bucket after
another. Sorting and grouping within a bucket are numpy's, moving and sorting by bucket are Spark's.

No bucket grows with a hot key as long as the mapper sends at most a few records of a key for each batch; the mappers here
settle what a batch alone can settle and send the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arbordex.llm.columns import mix, release
from arbordex.llm.tables import mapped, partitions

#: Buckets for each shuffle partition: a reducer holds one of them at a time, next to RESULT_BYTES of results. More of them mean
#: smaller rows, which compress worse and are more to sort.
BUCKETS = 2
#: Bytes of a batch that a mapper takes at once.
BATCH_BYTES = 6 << 20
#: Bytes of results that a reducer gathers before it sends them on.
RESULT_BYTES = 4 << 20
ROW = "row long, found array<binary>"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The high bits of a 64-bit key choose its bucket; the low ones stay to tell keys of a bucket apart."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def spread(rows: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for records that need no meeting."""
    return bucket_of(mix(rows.view(np.uint64)), buckets)


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(bucket[a]), b"".join(_planes(c[a:b]) for c in columns)


def _planes(column: np.ndarray) -> bytes:
    """The first bytes of all values, then all second bytes, and so on: high bytes, mostly equal, compress to almost nothing."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def unpack(payloads: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for i, k in enumerate(kinds):
            size = n * np.dtype(k).itemsize
            parts[i].append(np.frombuffer(p, np.uint8, size, at).reshape(-1, n).T.copy().view(k)[:, 0] if n else np.zeros(0, k))
            at += size
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds)]


Mapper = Callable[[pa.RecordBatch, int], Iterator[tuple[np.ndarray, list[np.ndarray]]]]
Reducer = Callable[[list[np.ndarray]], Iterator[tuple[np.ndarray, list[np.ndarray]]]]


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about BATCH_BYTES, which bounds what a mapper holds."""
    rows = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, 1))
    for first in range(0, b.num_rows, rows):
        yield b.slice(first, rows)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES of small ones, so that a mapper settles as much as it may hold."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and size + b.nbytes > BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for b in batches:
        for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(payload)
    if held:
        yield held


def _sent(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def scattered(df: DataFrame, mapper: Mapper) -> DataFrame:
    """(bucket, payload), dealt and sorted by bucket: mapper(batch, buckets) yields (bucket, columns). The first column of df is `row`."""
    buckets = BUCKETS * partitions(df.sparkSession)

    def scatter(batches):
        for b in gathered(part for whole in batches for part in slices(whole)):
            # equal rows share their number, and one of them speaks for all
            _, first = np.unique(b.column(0).to_numpy(), return_index=True)
            if len(first) < b.num_rows:
                b = b.take(pa.array(np.sort(first)))
            yield _rows([r for bucket, columns in mapper(b, buckets) for r in pack(bucket, columns)])
            release()

    return _sent(mapped(df, scatter, "bucket long, payload binary"))


def regroup(df: DataFrame, mapper: Mapper, kinds: list[str], reducer: Reducer, out: list[str]) -> DataFrame:
    """(row, found array<binary>), one for each row that something was found for: mapper(batch, buckets) yields (bucket, columns of
    `kinds`); reducer(columns of a bucket) yields (rows, columns of `out`); `found` is a list of one payload of `out`."""
    buckets = BUCKETS * partitions(df.sparkSession)

    def gather(batches):
        def flushed() -> pa.RecordBatch:
            every = np.concatenate(rows).astype("<i8")
            parts = [np.concatenate(c).astype(k) for c, k in zip(columns, out)]
            return _rows(list(pack(spread(every, buckets), [every, *parts])))

        rows, columns, size = [], [[] for _ in out], 0
        for payloads in by_bucket(batches):
            for found, parts in reducer(unpack(payloads, kinds)):
                if len(found):
                    rows.append(found)
                    for c, p in zip(columns, parts):
                        c.append(p)
                    size += found.nbytes + sum(p.nbytes for p in parts)
            if size > RESULT_BYTES:
                yield flushed()
                rows, columns, size = [], [[] for _ in out], 0
                release()
        if rows:
            yield flushed()

    def each(batches):
        for payloads in by_bucket(batches):
            rows, *columns = unpack(payloads, ["<i8", *out])
            packed = list(pack(rows, columns))
            for first in range(0, len(packed), 2000):
                part = packed[first : first + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([[r[1]] for r in part], pa.list_(pa.binary()))], ["row", "found"])

    return mapped(_sent(mapped(scattered(df, mapper), gather, "bucket long, payload binary")), each, ROW)
