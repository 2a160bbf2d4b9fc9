"""Dependency edges: neighbours, cycles, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.operators.lineage import kept

MAX_DEPTH = 12
MAX_SLICE = 16
MAX_CYCLES = 256
#: Hops that colours may take to settle, and hops between two looks at whether they have.
ROUNDS = 32
HOPS = 4
#: Open paths of a walk at which looking for components pays.
WIDE = 100_000
#: Rows that go to every executor in a join.
FEW = 10_000


def met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that moves both sides between executors. Loops join many times, and each table that Spark finds small enough to broadcast
    would pass through the driver anew."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def beside(left: DataFrame, right: DataFrame, on: str, how: str, n: int) -> DataFrame:
    """A join with a right side of n rows: where these are few each executor gets them, and the left side is never what is sent."""
    return left.join(F.broadcast(right), on, how) if n <= FEW else met(left, right, on, how)


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those whose end nothing enters or leaves, round by round until a round takes less than a tenth of them."""
    edges = kept(edges)
    before = edges.count()
    while before:
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = kept(met(met(edges, entered, "src", "left_semi"), left, "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now > 0.9 * before:
            break
        before = now
    return edges


def colours(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """(node, up, down): the smallest node that reaches a node, and the smallest that it reaches. None if `rounds` hops do not settle
    them."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    # what a node holds goes on to where its edges lead, back to where they come from, and to itself; so a hop is one join
    ways = edges.selectExpr("src AS node", "dst AS _to", "true AS _on", "false AS _back")
    ways = ways.union(edges.selectExpr("dst", "src", "false", "true")).union(nodes.selectExpr("node", "node", "true", "true"))
    ways = kept(ways.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node"))
    state, last = kept(nodes.select("node", F.col("node").alias("up"), F.col("node").alias("down"))), None
    for _ in range(0, rounds, HOPS):
        for _ in range(HOPS):
            told = met(ways, state, "node")
            state = told.groupBy(F.col("_to").alias("node")).agg(F.min(F.when(F.col("_on"), F.col("up"))).alias("up"), F.min(F.when(F.col("_back"), F.col("down"))).alias("down"))
        state = kept(state)
        # colours only fall, so equal sums are equal colours
        now = state.agg(F.sum(F.col("up").cast("decimal(38,0)")), F.sum(F.col("down").cast("decimal(38,0)"))).first()
        if now == last:
            return state
        last = now
    return None


def within_components(edges: DataFrame) -> DataFrame:
    """Edges within strongly connected components: the nodes of one reach each other, so the same smallest node reaches them and is
    reached, and an edge whose ends differ in either leaves its component. Without such edges colours tell more apart, until none is
    left. A graph with paths so long that colours do not settle stays as it is."""
    before = edges.count()
    while before and (found := colours(edges)) is not None:
        a, b = (found.select(F.col("node").alias(end), F.struct("up", "down").alias(f"_{end}")) for end in ("src", "dst"))
        edges = kept(met(met(edges, a, "src"), b, "dst").where("_src = _dst").select("src", "dst"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges


def _rotations(closed: DataFrame) -> DataFrame:
    """A cycle's path [a, b, ..., a] once from each of its nodes."""
    nodes, size = F.slice("path", 1, F.size("path") - 1), F.size("path") - 1
    turned = closed.select("path", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    after, before = F.slice(nodes, F.col("i") + 1, size - F.col("i")), F.slice(nodes, F.lit(1), F.col("i"))
    return turned.select(F.concat(after, before, F.array(F.get(nodes, F.col("i")))).alias("path"))


def _doubled(turned: DataFrame, loops: DataFrame) -> DataFrame:
    """Paths whose first node has an edge to itself, with that edge walked first."""
    first = turned.withColumn("_loop", F.get("path", F.lit(0)))
    return met(first, loops.select(F.col("src").alias("_loop")), "_loop", "left_semi").select(F.concat(F.slice("path", 1, 1), "path").alias("path"))


def cycles(edges: DataFrame, most: int | None = MAX_CYCLES, wide: int = WIDE) -> DataFrame:
    """(source_id, target_id, cycle_path, hop_count) of each simple cycle of at most 13 hops, once from each node on it, shortest
    first. An edge from a to itself may be walked first, so a loop alone is the path a,a,a of two hops. Equal edges count once; `most`
    rows are the report's size.

    Ends that nothing enters or leaves are trimmed, and each cycle is walked once, from its smallest node over larger ones; its other rows
    are rotations. A walk that grows to more than `wide` paths goes on within strongly connected components alone, which only saves work.
    Each level of the walk is kept, and the walk ends when shorter cycles fill the report."""
    edges = edges.where("dst is not null").select("src", "dst").distinct()
    loops = kept(edges.where("src = dst"))
    found = [_doubled(loops.select(F.array("src", "dst").alias("path")), loops)]
    edges, whole = trimmed(edges.where("src <> dst")), True
    walk = edges.where("src < dst").select(F.array("src", "dst").alias("path"))
    total = loops.count() if most else 0
    for depth in range(1, MAX_DEPTH + 1):
        origin, end = F.get("path", F.lit(0)), F.element_at("path", -1)
        ahead = met(walk.withColumn("src", end), edges, "src").where((F.col("dst") >= origin) & ((F.col("dst") == origin) | ~F.array_contains("path", F.col("dst"))))
        step = kept(ahead.select(F.concat("path", F.array("dst")).alias("path"), (F.col("dst") == origin).alias("closed")))
        n = step.agg(F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("open")).first()
        turned = _rotations(step.where("closed"))
        found.append(turned)
        if depth < MAX_DEPTH:
            found.append(_doubled(turned, loops))
        total += n["closed"] * (depth + 1)
        walk = step.where("not closed").select("path")
        if (most and total >= most) or not n["open"]:
            break
        if whole and n["open"] > wide:
            edges, whole = within_components(edges), False
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    out = every.select(
        F.get("path", F.lit(0)).alias("source_id"), F.element_at("path", -1).alias("target_id"), F.array_join(F.col("path").cast("array<string>"), ",").alias("cycle_path"), (F.size("path") - 1).cast("long").alias("hop_count")
    )
    return out.orderBy("hop_count", "source_id", "cycle_path").limit(most) if most else out


def slice_from(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """All edges, unresolved ones too, that leave a node reached from root in at most `depth` hops (0 to 16)."""
    step = kept(edges.where("dst is not null").select(F.col("src").alias("node"), F.col("dst").cast("long").alias("_to")).distinct())
    reached = frontier = edges.sparkSession.range(root, root + 1, 1, 1).toDF("node")
    n = new = 1
    for _ in range(min(max(depth, 0), MAX_SLICE)):
        after = beside(step, frontier, "node", "inner", new).select(F.col("_to").alias("node")).distinct()
        frontier = kept(beside(after, reached, "node", "left_anti", n))
        new = frontier.count()
        if not new:
            break
        reached, n = kept(reached.unionByName(frontier)), n + new
    return beside(edges, reached.select(F.col("node").alias("src")), "src", "left_semi", n)


def dependencies_of(edges: DataFrame, source: int) -> DataFrame:
    return edges.where(F.col("src") == source)


def dependents_of(edges: DataFrame, target: int) -> DataFrame:
    return edges.where(F.col("dst") == target)
