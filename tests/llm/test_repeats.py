"""Operators on repeats against brute force: rows are compared as multisets."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbordex.llm import op3_substrings, op5_jaccard, op8_suffixes, op10_lines
from arbordex.llm.graph import components
from arbordex.llm.tables import checkpointed

from samples import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


#: Rows that share an id or have none, the last id, and repeated rows.
def shared(corpus):
    rng = random.Random(8)
    w, v, z = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    near = z.split()
    near[7] = "changed"
    rows = [(1001, w), (None, w), (None, v), (2**63 - 1, z), (2**63 - 1, prose(rng, 80)), (1005, " ".join(near)), (1005, prose(rng, 90)), (None, v), (-5, w), (1007, None), (1007, "")]
    return [(r[0], r[1]) for r in corpus] + rows + [rows[0]]


@pytest.fixture(scope="module", params=["shared ids", "own ids"])
def rows(request, spark, corpus):
    given = shared(corpus)
    if request.param == "own ids":
        own = {k: (k, t) for k, t in given if k is not None}
        given = list(own.values())
    return given, spark.createDataFrame(given, "doc_id long, text string").repartition(3)


def place(k):
    return (k is None, k or 0)


def test_substrings(rows, none):
    given, docs = rows
    first = {}
    for k, t in given:
        w = words(t)
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            first[x] = min(first.get(x, place(k)), place(k))
    expected = []
    for k, t in given:
        w = words(t)
        drop = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < place(k) for j in range(i, i + 50)}
        expected.append((k, len(w), len(drop), " ".join(x for j, x in enumerate(w) if j not in drop)))
    assert Counter(tuple(r) for r in op3_substrings.deduplicated(docs, "doc_id", "text").collect()) == Counter(expected)
    assert any(0 < r[2] < r[1] for r in expected)
    assert op3_substrings.deduplicated(none, "doc_id", "text").count() == 0


def test_cover_is_a_difference_cover():
    p, c = op3_substrings.PERIOD, op3_substrings.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


def test_suffixes(rows, none):
    given, docs = rows
    texts = [(k, (t or "").encode()) for k, t in given]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    expected = []
    for k, t in texts:
        drop = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                drop[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], drop.astype(int)])) == 1).sum())
        expected.append((k, len(t), int(drop.sum()), spans, np.frombuffer(t, np.uint8)[~drop].tobytes()))
    got = op8_suffixes.deduplicated(docs, "doc_id", "text").collect()
    assert Counter((*r[:4], bytes(r.kept)) for r in got) == Counter(expected)
    assert any(0 < r[2] < r[1] for r in expected)
    assert op8_suffixes.deduplicated(none, "doc_id", "text").count() == 0


def expected_components(given):
    """(doc_id, set size, least doc_id of the component) of each row."""
    sets, parent = [], list(range(len(given)))
    for _, t in given:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(given):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least.get(root(i)), root(i)) for i, (k, _) in enumerate(given)]


def test_jaccard(rows, none):
    given, docs = rows
    expected = expected_components(given)
    assert Counter(tuple(r) for r in op5_jaccard.joined(docs, "doc_id", "text").collect()) == Counter(r[:3] for r in expected)
    assert len({r[3] for r in expected}) < len(expected) - 5
    assert op5_jaccard.joined(none, "doc_id", "text").count() == 0


def test_first_of_each_group_stays(rows, none):
    given, docs = rows
    groups, expected = {}, Counter()
    for (k, t), (_, n, _, group) in zip(given, expected_components(given)):
        groups.setdefault((group, n == 0 and (k, t)), []).append((place(k), k, t))
    for some in groups.values():
        if not words(some[0][2]):
            expected.update((k, t) for _, k, t in some)
        else:
            expected[min(some)[1]] += 1
    extra = docs.withColumn("row", F.lit(1)).withColumn("row_number", F.lit(2)).withColumn("component", F.lit("x")).withColumn("_kept", F.lit(0))
    got = op5_jaccard.first_of_each(extra, "doc_id", "text")
    assert got.columns == extra.columns
    assert Counter((r.doc_id, r.text) if not words(r.text) else r.doc_id for r in got.collect()) == expected
    assert op5_jaccard.first_of_each(none, "doc_id", "text").count() == 0


def test_jaccard_joins_where_it_may_not_broadcast(rows, monkeypatch):
    given, docs = rows
    plain = op5_jaccard.survivor_sets
    monkeypatch.setattr(op5_jaccard, "survivor_sets", lambda docs, info: plain(docs, info, most=2))
    assert Counter(tuple(r) for r in op5_jaccard.joined(docs, "doc_id", "text").collect()) == Counter(r[:3] for r in expected_components(given))


def one_kind(rng):
    """Variants of one set."""
    base, out = rng.integers(1, 1 << 62, 60, dtype=np.uint64), []
    for _ in range(150):
        s = base.copy()
        change = rng.integers(0, 60, int(rng.integers(0, 16)))
        s[change] = rng.integers(1, 1 << 62, len(change), dtype=np.uint64)
        out.append(np.unique(s))
    return out


def chained(rng):
    """A long chain of sets that each share half of themselves with the next, some of them twice with small changes."""
    parts, out = [rng.integers(1, 1 << 62, 30, dtype=np.uint64) for _ in range(111)], []
    for i in range(110):
        s = np.concatenate([parts[i], parts[i + 1]])
        out.append(np.unique(s))
        if i % 3 == 0:
            s[rng.integers(0, 60, 4)] = rng.integers(1, 1 << 62, 4, dtype=np.uint64)
            out.append(np.unique(s))
    return out


@pytest.mark.parametrize("made, shingled", [(one_kind, None), (chained, True)])
def test_large_clusters_lose_no_link(spark, monkeypatch, made, shingled):
    sets = made(np.random.default_rng(3))
    sent = []
    plain = op5_jaccard._tree_links
    monkeypatch.setattr(op5_jaccard, "_tree_links", lambda dealt, survivors: (sent.append(dealt.count()), plain(dealt, survivors))[1])
    survivors = checkpointed(spark.createDataFrame([(i - 70, bytearray(s.tobytes())) for i, s in enumerate(sets)], "row long, hashes binary"))
    clusters = spark.createDataFrame([(i - 70, 0) for i in range(len(sets))], "row long, component long")
    found = checkpointed(op5_jaccard.links(survivors, clusters, block=8))
    small = [(r.id + 70, r.component + 70) for r in components(found).collect()]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    # a chain that nothing but overlaps hold together is not compared block by block
    assert not shingled or sent[1] < 20 * len(sets)
    assert dict(small) == {i: root(i) for i in range(len(sets)) if any(root(j) == root(i) for j in range(len(sets)) if j != i)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def expected_lines(texts, least=10):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    count = Counter(k for t in texts for k in {key(x) for x in t.split("\n")})
    return {t: [x for x in t.split("\n") if not (len(key(x)) >= 1 and count[key(x)] >= least)] for t in texts}


def test_lines(rows, none):
    given, docs = rows
    kept = expected_lines([t or "" for _, t in given])
    named = docs.withColumn("hash", F.lit(1)).withColumn("n_lines", F.lit("mine")).withColumn("c0", F.lit(3)).withColumn("digest", F.lit(4))
    for most in (10, 0):
        runs = op10_lines.LineRuns(docs.sparkSession)
        runs.add(op10_lines.batch_counts(docs, "text"))
        got = op10_lines.clean(named, "text", runs, most=most).collect()
        expected = Counter((k, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept[t or ""]), "\n".join(kept[t or ""])) for k, t in given)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == expected
    assert sum(len(t.split("\n")) - len(k) for t, k in kept.items()) > 10
    cleaned = op10_lines.drop_common(named.withColumn("n_dropped", F.lit(0)).withColumn("kept_text", F.lit("")), "text")
    assert Counter((r.doc_id, r.text) for r in cleaned.collect()) == Counter((k, t if t is None else "\n".join(kept[t])) for k, t in given)
    assert {r.n_lines for r in cleaned.collect()} == {"mine"}
    assert op10_lines.drop_common(none, "text", "n_chars").count() == 0


def test_lines_query_takes_files_as_batches(spark, rows, tmp_path):
    given, docs = rows
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    kept = expected_lines([t or "" for _, t in given])
    expected = Counter((k, hashlib.sha256("\n".join(kept[t or ""]).encode()).hexdigest()) for k, t in given)
    for batches in (1, 3, 7):
        assert Counter((r.doc_id, r.kept_sha256) for r in op10_lines.op10_lines(spark, str(tmp_path), batches).collect()) == expected
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op10_lines.op10_lines(spark, str(tmp_path / "none")).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_runs_are_levelled_and_new_lines_are_new(spark, docs):
    runs = op10_lines.LineRuns(spark, documents=5)
    batches = [spark.createDataFrame([(f"a\nb{i}",), (f"c{i % 2}",)], "text string") for i in range(6)]
    fresh = []
    for b in batches:
        counts = op10_lines.batch_counts(b, "text")
        fresh.append(runs.new_lines(counts).count())
        runs.add(counts)
    assert fresh == [3, 2, 1, 1, 1, 1]
    assert [len(x) for x in runs.levels] == [0, 1, 1]
    plan = runs.unsettled(op10_lines.batch_counts(batches[0], "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and plan.count("Exchange") == 1
    assert Counter(r.n for r in runs.seen().collect()) == {6: 1, 1: 6, 3: 2}
    runs.close()


def test_failures_leave_no_tables(spark, docs, tmp_path, monkeypatch):
    from pathlib import Path

    from arbordex.llm.tables import shared_dir

    left = lambda: [t.name for t in spark.catalog.listTables() if not t.isTemporary] + [p.name for p in Path(shared_dir(spark)).glob("*") if p.name.startswith(("arbordex_", "line_runs"))]
    assert not left()

    def broken(*_, **__):
        raise RuntimeError("lost")

    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(op10_lines, "clean", broken)
    monkeypatch.setattr(op10_lines, "_cleaned", broken)
    monkeypatch.setattr(op5_jaccard, "links", broken)
    for run in (lambda: op10_lines.op10_lines(spark, str(tmp_path)), lambda: op10_lines.drop_common(docs, "text"), lambda: op5_jaccard.op5_jaccard(spark, str(tmp_path))):
        with pytest.raises(RuntimeError, match="lost"):
            run()
        assert not left()


def test_a_table_of_one_file_meets_the_runs(spark, rows, tmp_path):
    """Each of its batches but the first is anti-joined with the runs before it."""
    given, docs = rows
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    batches = op10_lines.file_batches(spark, whole)
    assert len(batches) == op10_lines.BATCHES and sum(b.count() for b in batches) == len(given)
    with op10_lines.LineRuns(spark) as runs:
        for b in batches:
            counts = op10_lines.batch_counts(b, "text")
            plan = runs.unsettled(counts)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("LeftAnti") == sum(map(len, runs.levels))
            runs.add(counts)
        assert [len(x) for x in runs.levels] == [0, 0, 1]
