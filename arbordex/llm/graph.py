"""Connected components of edges that no single machine holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.llm.tables import checkpointed, mapped, partitions


def _contract(batches):
    """Edges of one task as stars: each node with the smallest that the task's own edges connect it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(a), root(c)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(n, r) for n in parent if (r := root(n)) != n]
    for first in range(0, len(found), 100_000):
        a, c = zip(*found[first : first + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _small_stars(batches):
    """For each node of a task, which has all edges that the node is the larger end of: it and its other neighbours move to its
    smallest."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    least = b[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([np.concatenate([a[new], b[b != least]]), np.concatenate([least[new], least[b != least]])]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in `edges` (a, b): the smallest id reachable. Null ends are ignored.

    What a task's own edges connect is contracted first. Then large stars (a node's larger neighbours move to its smallest; the
    smallest is aggregated before the shuffle and kept, so that both sides of the join are plain exchanges and Spark splits a node
    with many neighbours) and small stars (a node's smaller neighbours do) alternate until nothing moves. Each round is kept in
    the shared folder.
    """
    size = partitions(edges.sparkSession)
    edges = mapped(edges.where("a is not null and b is not null and a <> b").select("a", "b"), _contract, "a long, b long")
    edges, before = checkpointed(edges), None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(mapped(large.repartition(size, "a"), _small_stars, "a long, b long"))
    # at rest each node has one edge, to its component
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
