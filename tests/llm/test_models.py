"""Whitening, resampling and decontamination against brute force: rows are compared as multisets."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from arbordex.llm import op11_whitening, op12_resampling, op13_decontamination

from samples import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


# ---- whitening


def embedded(rng, n=300, size=6):
    """Vectors with a strong first direction, copies, near copies and rows that must go."""
    base = rng.normal(size=(n, size)) * np.array([3, 2, 1, 0.5, 0.25, 0.1])[:size] + 5
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)] + [(2000, [c + 0.0001 for c in rows[9][1]], 0), (None, rows[3][1], 0), (5, rows[4][1], 0), rows[5]]
    bad = [(3000, None, 0), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (3002, [math.nan] + [0.0] * 5, 0), (3003, [math.inf] + [0.0] * 5, 0), (3004, [], 0), (3005, [1.0] * 7, 0), (3006, [1e300] + [0.0] * 5, 0)]
    return rows, bad


EMBEDDED = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("fan_in", [2, 8])
def test_whitening(spark, fan_in):
    rows, bad = embedded(np.random.default_rng(1))
    df = spark.createDataFrame(rows + bad, EMBEDDED).repartition(5)
    got = op11_whitening.whiten(df, "vec_id", "embedding", fan_in=fan_in).collect()
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, total = len(fit), np.array(fit).sum(axis=0)
    centre = np.array([[float(Fraction(n * c - int(s), n)) for c, s in zip(v, total)] for v in fit])
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    assert all(r.identity_error < 1e-9 for r in got)
    deviation = Counter((r.vec_id, r.deviation) for r in got if r.component == 1)
    assert deviation == Counter((k, sum((n * c - int(s)) ** 2 for c, s in zip(v, total))) for (k, _, _), v in zip(rows, x))
    for k in range(4):
        mine = [r for r in got if r.component == k + 1]
        assert all(abs(r.explained - values[k] / values.sum()) < 1e-10 for r in mine)
        expected = {key: float((np.array(v) - total / n) @ vectors[:, k] / math.sqrt(values[k])) for (key, _, _), v in zip(rows, x) if key not in (5, None)}
        sign = math.copysign(1, sum(expected[r.vec_id] * r.whitened for r in mine if r.vec_id in expected))
        assert all(abs(sign * r.whitened - expected[r.vec_id]) < 1e-9 for r in mine if r.vec_id in expected)


def test_whitening_keeps_every_covariance(spark):
    """All components: the whitened fit list has the identity as covariance."""
    rows, _ = embedded(np.random.default_rng(2), 200)
    df = spark.createDataFrame(rows[:200], EMBEDDED).repartition(7)
    got = op11_whitening.whiten(df, "vec_id", "embedding", components=6).collect()
    w = np.zeros((200, 6))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], EMBEDDED)
    assert op11_whitening.whiten(empty, "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], EMBEDDED)
    got = op11_whitening.whiten(same, "vec_id", "embedding").collect()
    assert len(got) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), float(i)], 0) for i in range(9)], EMBEDDED)
    got = op11_whitening.whiten(line, "vec_id", "embedding").collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True)}
    assert op11_whitening.whiten(spark.createDataFrame([(1, [], 0)], EMBEDDED), "vec_id", "embedding").count() == 0


def test_whitening_of_large_numbers(spark):
    """Sums and deviations stay exact where longs overflow; what fits no long is null."""
    rows = [(i, [float(2**52 + i * 2**20), float(i)], 0) for i in range(12)]
    got = op11_whitening.whiten(spark.createDataFrame(rows, EMBEDDED), "vec_id", "embedding").where("component = 1").collect()
    x = [[256 * int(c) for c in v] for _, v, _ in rows]
    total = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((12 * c - s) ** 2 for c, s in zip(x[r.vec_id], total))
        assert r.deviation == (exact if exact < 2**63 else None)


def test_whitening_query(spark, tmp_path):
    rows, bad = embedded(np.random.default_rng(3), 80)
    clash = spark.createDataFrame([(*r, 1, 2.0) for r in rows + bad], EMBEDDED + ", n int, whitened double").repartition(3)
    clash.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening.op11_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 4 * len(rows)


# ---- resampling


def expected_draw(docs, items, percent=25):
    def features(t):
        w = words(t)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    source, target = Counter(), Counter()
    for _, t in docs:
        source.update(map(bucket, features(t)))
    for t in items:
        target.update(map(bucket, features(t)))
    s_all, t_all = sum(source.values()), sum(target.values())
    rows = []
    for k, t in docs:
        own = [bucket(f) for f in features(t)]
        g = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in own]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= 20))
    eligible = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = percent * len(eligible) // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(eligible[:draw])]
    rest = [(*r[:4], None) for r in eligible[draw:]] + [(*r[:4], None) for r in rows if not r[4]]
    return drawn + rest


@pytest.fixture(scope="module")
def resampled_rows():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(160)]
    rows += [(9, prose(rng, 40)), (9, rows[9][1]), (None, rows[3][1]), (-4, "  "), (2**63 - 1, "É é " * 30), (500, None), (501, ""), (502, "a" * 5000), (503, prose(rng, 19)), (504, prose(rng, 20)), (505, prose(rng, 9000))]
    rows += [(None, rows[0][1] + " more words " * 20)] * 30 + [(77, rows[1][1] + " again " * 25)] * 30
    return rows, [prose(rng, 30), prose(rng, 5), None, "", "Alpha BETA gammas"]


@pytest.mark.parametrize("percent", [25, 100, 0])
@pytest.mark.parametrize("size, fan_in", [(500_000, 64), (7, 2), (1, 2)])
def test_resampling(spark, resampled_rows, size, fan_in, percent):
    rows, items = resampled_rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = op12_resampling.resampled(df, "doc_id", "text", target, "text", percent=percent, size=size, fan_in=fan_in).collect()
    assert Counter(map(tuple, got)) == Counter(expected_draw(rows, items, percent))


def test_scores_of_many_rows_are_cut_by_id(spark):
    """Texts without target words all weigh alike; equal noise then makes equal scores."""
    rows = [(i % 50, "same words here " * 8) for i in range(400)] + [(None, "same words here " * 8)] * 40
    df, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([], "text string")
    got = op12_resampling.resampled(df, "doc_id", "text", target, "text", size=3).collect()
    assert Counter(map(tuple, got)) == Counter(expected_draw(rows, []))


def test_cut_covers_the_draw_exactly():
    ranges, lowest = op12_resampling.cut([(9, 0, 2), (8, 0, 5), (8, 1, 5), (7, 0, 1), (6, 0, 9)], 12, 5)
    assert ranges == [(9, 0, 0, 2), (8, 0, 2, 5), (8, 1, 7, 5)] and lowest == 8
    assert op12_resampling.cut([(9, 0, 2)], 0)[0] == []


def test_tournament_is_a_stable_merge():
    rng = random.Random(3)
    for _ in range(50):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        got = [(runs[r][i], r, i) for r, i in op12_resampling.Tournament(runs)]
        assert got == sorted((k, r, i) for r, run in enumerate(runs) for i, k in enumerate(run))


def test_resampling_query(spark, resampled_rows, tmp_path):
    rows, items = resampled_rows
    given = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id long, text string, rank int, score int").repartition(4)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = op12_resampling.op12_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == Counter(expected_draw(rows, items))
    given.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert op12_resampling.op12_resampling(spark, str(tmp_path / "none")).count() == 0


# ---- decontamination


def expected_marks(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    sizes, out = {len(w) for w in windows}, []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((k, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(10, 40))) for i in range(30)]
    items += [(100, "one two three"), (101, "q"), (102, "çà et là"), (103, ""), (104, None), (105, "?! --"), (None, prose(rng, 12)), (7, prose(rng, 15)), (8, items[8][1]), (106, items[8][1]), (107, "x " * 14), (108, "y" * 400 + " z")]
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        w = words(t)
        docs.append((200 + i, prose(rng, 12) + ". " + " -- ".join(w).upper() + "\n" + prose(rng, 5)))
        docs.append((300 + i, prose(rng, 3) + " " + " ".join(w[2:11]) + " end"))
        docs.append((400 + i, " ".join(w[:11])))
    docs += [(500, None), (501, ""), (502, "..."), (503, "q"), (504, "qq q1 1q"), (505, "one two  three"), (506, "one two threes"), (507, "ÇÀ et là çà et là"), (508, "x " * 40), (509, "x" * 2000), (510, "y" * 399 + " z"), (511, "y" * 400 + " z"), (512, "y" * 401 + " z")]
    docs += [(None, items[0][1]), (None, items[0][1]), (-1, items[3][1] * 3), docs[61], (600, prose(rng, 3000) + " " + items[5][1] + " " + prose(rng, 3000)), (601, "one two"), (602, "three")]
    return docs, items


@pytest.mark.parametrize("most", [op13_decontamination.SLICE_BYTES, 4000])
def test_decontamination(spark, leaks, most):
    docs, items = leaks
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = op13_decontamination.contaminated(df, "doc_id", "text", benchmark, "item_id", "text", most=most).collect()
    assert Counter(map(tuple, got)) == Counter(expected_marks(docs, items))


def test_long_items_alone(spark, leaks):
    """Without short items the search skips most of a text."""
    docs, items = leaks
    items = [x for x in items if len(words(x[1])) >= 10]
    strings = sorted({f" {' '.join(words(t)[i : i + 10])} ".encode() for _, t in items for i in range(len(words(t)) - 9)})
    tables = op13_decontamination.Tables(strings, [[] for _ in strings])
    raw = np.frombuffer(prose(random.Random(1), 4000).encode(), np.uint8)
    plain = op13_decontamination.Plain(raw, np.array([0, len(raw)]))
    assert max(s.deepest for s in tables.searchers) > 10
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = op13_decontamination.contaminated(df, "doc_id", "text", benchmark, "item_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(expected_marks(docs, items))
    assert not tables.search(plain)[0].any()


def test_search_of_random_strings():
    """Few letters and short strings: every shift and bucket is met."""
    rng = random.Random(9)
    for _ in range(60):
        items = [(i, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 12)))) for i in range(rng.randint(1, 6))]
        docs = [(i, "".join(rng.choice("ab  .") for _ in range(rng.randint(0, 400)))) for i in range(5)]
        windows = {}
        for k, t in items:
            w = t.split()
            n = min(len(w), 10)
            for i in range(len(w) - n + 1):
                windows.setdefault(f" {' '.join(w[i : i + n])} ".encode(), set()).add(str(k))
        tables = op13_decontamination.Tables(list(windows), [sorted(x) for x in windows.values()])
        raw = [t.encode() for _, t in docs]
        plain = op13_decontamination.Plain(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        hit, found = tables.search(plain)
        for i, (e, (a, b)) in enumerate(zip(expected_marks(docs, items), zip(plain.first, plain.first[1:]))):
            own = {k for n in found[i] for k in tables.items[n]}
            assert (b - a, hit[a:b].sum(), len(own)) == e[1:4]


def test_decontamination_queries(spark, leaks, tmp_path):
    docs, items = leaks
    given = spark.createDataFrame([(*r, "h", 1) for r in docs], "doc_id long, text string, hit string, n_words int").repartition(3)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = op13_decontamination.op13_decontamination(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(expected_marks(docs, items))
    benchmark = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    kept = op13_decontamination.clean(given, "doc_id", "text", benchmark, "item_id", "text")
    assert kept.columns == given.columns
    assert Counter(map(tuple, kept.collect())) == Counter((*r, "h", 1) for r, e in zip(docs, expected_marks(docs, items)) if not e[5])
    none = spark.createDataFrame([], "item_id long, text string")
    assert op13_decontamination.contaminated(given, "doc_id", "text", none, "item_id", "text").where("contaminated").count() == 0
    assert op13_decontamination.contaminated(given.limit(0), "doc_id", "text", benchmark, "item_id", "text").count() == 0
