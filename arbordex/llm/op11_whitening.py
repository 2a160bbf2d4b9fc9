"""Operator 11, embedding whitening by TSQR.

1. Quantise: an entry c becomes the whole number x = floor(SCALE * c). The fit list is each distinct x vector once: one shuffle of packed
   vectors, whose copies a task folds before it sends them.
2. Sum: n and the exact sum S of each dimension, as high and low halves that cannot overflow.
3. TSQR: each partition centres its rows ((n x - S) exactly, then / n) and folds them into one R factor, a batch at a time. R factors are
   merged FAN_IN at a time by tasks in a tree of fixed depth, and the driver takes the SVD of the last one (dimensions x dimensions):
   its right vectors are the covariance's eigenvectors and its squared singular values / n the eigenvalues. No covariance is formed.
4. Whiten: a row's centred vector times the right vectors, over the square roots of the eigenvalues.

Memory: an R factor has dimensions squared doubles (8 MB at 1,024), FAN_IN of them meet in a merge; the driver gets one. The result
does not depend on how rows lie but for the last bits of a double and one sign for a component.

Rows are dropped whose vector is null, holds a null or non-finite entry or one that SCALE takes out of the range of a long, or has
another length than most vectors of the table (ties: the longer). Repeated rows and rows that share an id or have none each give their
rows. `deviation` is null where it does not fit a long. A component whose eigenvalue is 0 to double precision (as with one
distinct vector) has no direction of its own: `whitened` is null, and `explained` is null where all eigenvalues are 0.
Fewer dimensions than components: fewer rows. Empty table: no rows. Other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.tables import checkpointed, mapped, partitions, table

SCALE = 256
COMPONENTS = 4
FAN_IN = 8
#: Numbers that one numpy pass takes on.
PASS = 1 << 19
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the column that hold a vector of `size` good entries, their x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    whole = np.flatnonzero((lengths == size) & column.is_valid().to_numpy(zero_copy_only=False))
    starts = column.offsets.to_numpy()[whole]
    entries = column.values.cast(pa.float64())
    values = entries.fill_null(np.nan).to_numpy()[starts[:, None] + np.arange(size)]
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
    good = (np.abs(scaled) < 2.0**63).all(axis=1)  # false for nan and inf
    return whole[good], scaled[good].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest whole numbers that hold it: equal vectors have equal bytes, and the length tells the width."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.zeros(len(x), np.int64)
    for k, kind in enumerate(_WIDTHS[:-1]):
        width[(low < np.iinfo(kind).min) | (high > np.iinfo(kind).max)] = k + 1
    out: list[bytes] = [b""] * len(x)
    for k in np.unique(width).tolist():
        at = np.flatnonzero(width == k)
        for i, row in zip(at.tolist(), x[at].astype(_WIDTHS[k])):
            out[i] = row.tobytes()
    return out


def unpacked(column: pa.Array, size: int):
    """The vectors of a column of packed ones, some rows at a time."""
    rows = max(1, PASS // max(size, 1))
    for first in range(0, len(column), rows):
        raw = column.slice(first, rows).to_pylist()
        out = np.zeros((len(raw), size), np.int64)
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by_width.setdefault(len(r) // size, []).append(i)
        for width, at in by_width.items():
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{width}").reshape(-1, size)
        yield out


def common_size(df: DataFrame, vector: str) -> int:
    """The length of most vectors, ties to the longer; 0 without vectors."""
    sizes = df.where(df[vector].isNotNull()).groupBy(F.size(df[vector]).alias("size")).count()
    top = sizes.orderBy(F.col("count").desc(), F.col("size").desc()).limit(1).collect()
    return top[0]["size"] if top else 0


def fit_list(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(x binary): each distinct x vector once, packed."""

    def run(batches):
        for b in batches:
            # a batch folds its own copies; the aggregate's map side folds those of a task
            yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(packed(vectors(b.column(0), size)[1]))), pa.binary())], ["x"])

    return mapped(df.select(df[vector].cast("array<double>").alias("v")), run, "x binary").distinct()


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(n, exact sum of each dimension) of the fit list."""

    def run(batches):
        n, high, low = 0, np.zeros(size, object), np.zeros(size, object)
        for b in batches:
            for x in unpacked(b.column(0), size):
                n += len(x)
                high += (x >> 32).sum(axis=0).astype(object)
                low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        total = [int(h) * (1 << 32) + int(v) for h, v in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(t) for t in total], pa.string())], ["dim", "n", "total"])

    rows = mapped(fit, run, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {r["dim"]: int(r["total"]) for r in rows}
    return (rows[0]["n"], [totals[i] for i in range(size)]) if rows else (0, [0] * size)


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: longs where they can't overflow, else Python's numbers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None where it does not fit a long."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in ((d.astype(object) ** 2).sum(axis=1)).tolist()]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return deviations(x, n, total).astype(np.float64) / n


def folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The R factor of an R factor and more rows."""
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def r_factor(fit: DataFrame, size: int, n: int, total: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """R of the centred fit list: one factor for each partition, then a tree of merges."""

    def leaf(batches):
        r = np.zeros((0, size))
        for b in batches:
            for x in unpacked(b.column(0), size):
                r = folded(r, centred(x, n, total))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()] if len(r) else [], pa.binary())], ["r"])

    def merge(group: pa.Table) -> pa.Table:
        r = np.zeros((0, size))
        for raw in sorted(group["r"].to_pylist()):  # the same sum whatever order they come in
            r = folded(r, np.frombuffer(raw).reshape(-1, size))
        return pa.table({"node": pa.array([group["node"][0].as_py()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    width = max(2, partitions(fit.sparkSession))  # of the exchange that made the list, at most
    level = mapped(fit, leaf, "r binary").select(F.spark_partition_id().alias("node"), "r")
    while width > 1:
        level = level.select(F.floor(F.col("node") / fan_in).cast("int").alias("node"), "r").groupBy("node").applyInArrow(merge, "node int, r binary")
        width = -(-width // fan_in)
    last = [np.frombuffer(x["r"]).reshape(-1, size) for x in level.collect()]
    return np.linalg.qr(np.vstack(last), mode="r") if last else np.zeros((0, size))


class Whitening:
    """What the fit list says: n, sums, right vectors (a column each) and eigenvalues of all components, falling."""

    def __init__(self, size: int, n: int, total: list[int], r: np.ndarray):
        self.size, self.n, self.total = size, n, total
        _, sigma, right = np.linalg.svd(r, full_matrices=True) if len(r) else (None, np.zeros(0), np.eye(size))
        sigma = np.concatenate([sigma, np.zeros(size - len(sigma))])
        self.vectors, self.values = right.T, sigma**2 / max(n, 1)
        self.trace = float(self.values.sum())
        # below this an eigenvalue is rounding
        self.real = sigma > sigma.max(initial=0.0) * max(n, size) * np.finfo(np.float64).eps

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """(rows, components); nan where a component has no direction of its own."""
        out = centred(x, self.n, self.total) @ self.vectors[:, :components]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.real[:components], out / np.sqrt(self.values[:components]), np.nan)


def fitted(df: DataFrame, vector: str, components: int = COMPONENTS, fan_in: int = FAN_IN) -> tuple[Whitening, float | None]:
    """The whitening of a table's vectors, and the largest entry of |covariance of the whitened fit list - identity|."""
    size = common_size(df, vector)
    if not size:
        return Whitening(0, 0, [], np.zeros((0, 0))), None
    fit = checkpointed(fit_list(df, vector, size))
    n, total = sums(fit, size)
    made = Whitening(size, n, total, r_factor(fit, size, n, total, fan_in) if n else np.zeros((0, size)))
    real = [k for k in range(min(components, size)) if made.real[k]]
    if not real:
        return made, None

    def run(batches):
        for b in batches:
            for x in unpacked(b.column(0), size):
                w = made.whitened(x, components)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in real], [f"w{k}" for k in real])

    pairs = [(a, b) for a in real for b in real if a <= b]
    white = mapped(fit, run, ", ".join(f"w{k} double" for k in real))
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return made, max(abs(found[i] - (a == b)) for i, (a, b) in enumerate(pairs))


def whiten(df: DataFrame, key: str, vector: str, components: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """(key, SCHEMA) for each row of df that has a good vector, and each of the first components."""
    made, error = fitted(df, vector, components, fan_in)
    most = min(components, made.size)
    share = [float(v) / made.trace if made.trace > 0 else None for v in made.values[:most]]
    shared = df.sparkSession.sparkContext.broadcast(made)
    rows = max(1, PASS // max(made.size, 1))

    def run(batches):
        model = shared.value
        for whole in batches if most else ():
            for first in range(0, whole.num_rows, rows):
                b = whole.slice(first, rows)
                at, x = vectors(b.column(1), model.size)
                w = model.whitened(x, most)
                deviation = np.repeat(np.array(squares(deviations(x, model.n, model.total)), object), most)
                n = len(at) * most
                columns = [
                    b.column(0).take(pa.array(np.repeat(at, most))),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(at))),
                    pa.array([model.n] * n, pa.int64()),
                    pa.array(deviation.tolist(), pa.int64()),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(share * len(at), pa.float64()),
                    pa.array([error] * n, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["c0", *(f.split()[0] for f in SCHEMA.split(", "))])

    source = df.select(df[key].alias("c0"), df[vector].cast("array<double>").alias("v"))
    return mapped(source, run, f"c0 {dict(df.dtypes)[key]}, {SCHEMA}").withColumnRenamed("c0", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
