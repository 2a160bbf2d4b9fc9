"""Cycles against brute force, and what is walked for them."""

import random

import pytest

from arbordex.operators import graph


def walked(edges):
    """Every closed path, found from each of its nodes; an edge from a node to itself may come first."""
    edges = sorted({(a, b) for a, b in edges if b is not None})
    out, walk = [], [list(e) for e in edges]
    for _ in range(graph.MAX_DEPTH):
        step = [[*p, b] for p in walk for a, b in edges if a == p[-1]]
        out += [(p[0], p[-1], ",".join(map(str, p)), len(p) - 1) for p in step if p[-1] == p[0]]
        walk = [p for p in step if p[-1] not in p[:-1]]
    return sorted(out, key=lambda r: (r[3], r[0], r[2]))


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(13 + seed)] + [(4, 4), (1, None), (20, 21), (21, 20)]
    expected = walked(edges)
    assert [tuple(r) for r in graph.cycles(frame(spark, edges)).collect()] == expected[:256]
    assert sorted(map(tuple, graph.cycles(frame(spark, edges), None, wide=0).collect())) == sorted(expected)


def test_long_cycles_and_loops(spark):
    ring = [(i, (i + 1) % 13) for i in range(13)] + [(100 + i, 100 + (i + 1) % 14) for i in range(14)] + [(5, 5), (200, 200)]
    got = [tuple(r) for r in graph.cycles(frame(spark, ring)).collect()]
    assert got == walked(ring) and {r[3] for r in got} == {2, 13}
    assert graph.cycles(frame(spark, [])).count() == 0


def test_only_components_are_walked(spark):
    """Two rings joined by a path that trimming leaves there: the path and the bridge go, the rings stay."""
    rings = [(1, 2), (2, 3), (3, 1), (50, 51), (51, 50)]
    bridge = [(3, 10), (10, 11), (11, 12), (12, 50), (3, 12)]
    assert {tuple(r) for r in graph.trimmed(frame(spark, rings + bridge)).collect()} == set(rings + bridge)
    assert {tuple(r) for r in graph.within_components(frame(spark, rings + bridge)).collect()} == set(rings)
    # colours that do not settle leave the graph as it is
    assert graph.colours(frame(spark, [(i + 1, i) for i in range(40)]), rounds=8) is None
    found = {r.node: (r.up, r.down) for r in graph.colours(frame(spark, rings + bridge)).collect()}
    assert found[10] == (1, 10) and found[50] == (1, 50) and found[3] == (1, 1)


def test_tables_that_grow_are_not_broadcast(spark):
    """Pairs and a ring among them; an executor's copy of a table may hold 3 MB, an empty one takes 2."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        pairs = spark.range(400_000).selectExpr("id + 100 AS src", "(id ^ 1) + 100 AS dst")
        assert graph.trimmed(pairs).count() == 400_000
        assert [tuple(r) for r in graph.cycles(pairs, 2).collect()] == [(100, 100, "100,101,100", 2), (101, 101, "101,100,101", 2)]
        assert graph.within_components(pairs.union(spark.createDataFrame([(101, 102), (103, 104)], "a long, b long"))).count() == 400_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_a_slice_sends_its_front_and_not_the_edges(spark, monkeypatch):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        chain = spark.range(300_000).selectExpr("id AS src", "CASE WHEN id <> 9 THEN id + 1 END AS dst")
        few = [(i, i + 1 if i != 9 else None) for i in range(3, 10)]
        for rows in (graph.FEW, 0):  # fronts sent, and fronts joined by shuffles
            monkeypatch.setattr(graph, "FEW", rows)
            assert sorted(map(tuple, graph.slice_from(chain, 3, 17).collect())) == few
            assert sorted(map(tuple, graph.slice_from(chain, 3, 2).collect())) == few[:3]
            assert [tuple(r) for r in graph.slice_from(chain, 9, 4).collect()] == few[-1:]
            assert [tuple(r) for r in graph.slice_from(chain, 7, 0).collect()] == few[4:5]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
