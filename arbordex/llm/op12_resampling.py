"""Operator 12, target-distribution importance resampling.

1. Count: the buckets (crc32 modulo BUCKETS) of the 1- and 2-word features of all documents and of all target texts; a task sends one
   number for each bucket it met. BUCKETS gains, floor(1000 ln of the two smoothed shares' ratio), are broadcast.
2. Score: an array lookup and a sum give each document's weight, floor of its features' mean gain; with Gumbel noise from its id added
   it is the score, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000). Each partition is
   sorted by score, falling, then doc_id: a run, kept in the checkpoint folder. A run begins with the documents of at least
   `least_words` words, the eligible ones.
3. Merge: the counts of eligible scores say the exact draw and which scores it reaches. They are cut into ranges of about RANGE rows;
   scores with more rows than that are cut by doc_id too. A range takes its stretch of each run and merges the stretches by tournament
   trees of at most FAN_IN runs, in several passes if there are more, ends at the draw count, and numbers what it emits from the rows
   of the ranges before it. Nothing is merged in one task, and no rank needs a window over all rows.

What the driver holds: BUCKETS numbers, and one number for each score or slice of a score. Scores are whole numbers between
(1000 ln of the smallest ratio) - 3100 and (that of the largest) + 22200, at most some 100,000 of them however many rows there are.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null or empty text: no features, weight 0, not eligible. A null doc_id hashes
as the empty text and comes after all ids of its score; equal rows travel as one record with a count and take consecutive ranks. Rows
that share a doc_id are rows of their own. No target texts: t and T are 0. Empty table: no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.tables import checkpointed, mapped, partitions, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
#: Rows of a range of ranks, and runs that one tournament tree merges.
RANGE = 500_000
FAN_IN = 64
#: Slices that a score with more than RANGE rows is cut into, by doc_id.
SLICES = 64
#: Bytes of text whose features are held at once.
PASS_BYTES = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "n_features long, weight long, score long, rank long"
_RECORD = np.dtype([("score", "<i8"), ("nameless", "<i8"), ("doc_id", "<i8"), ("n_features", "<i8"), ("weight", "<i8"), ("n", "<i8")])


def features(text: bytes) -> list[int]:
    """crc32 of each feature of a text: its words, then its pairs of neighbours, repeats included."""
    words = WORD.findall(text.lower())
    ones = list(map(crc32, words))
    return ones + [crc32(w, crc32(b" ", c)) for c, w in zip(ones, words[1:])]


def _bucketed(column: pa.Array):
    """(buckets, features of each text) of some texts after another."""
    held, counts, size = [], [], 0
    for t in column.cast(pa.large_binary()):
        raw = t.as_py() or b""
        own = features(raw)
        held += own
        counts.append(len(own))
        size += len(raw)
        if size > PASS_BYTES:
            yield np.array(held, np.int64) % BUCKETS, np.array(counts, np.int64)
            held, counts, size = [], [], 0
    if counts:
        yield np.array(held, np.int64) % BUCKETS, np.array(counts, np.int64)


def bucket_counts(df: DataFrame, text: str) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for buckets, _ in _bucketed(b.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = mapped(df.select(df[text].alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + BUCKETS) / ((s + 1) (T + BUCKETS)))) of each bucket."""
    every_source, every_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every_source / ((s + 1.0) * every_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """floor of 1000 times a Gumbel variate that a doc_id fixes."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, key: str, text: str, weights: np.ndarray, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            counts, means = [], []
            for buckets, n in _bucketed(b.column(1)):
                sums = np.concatenate([[0], np.cumsum(shared.value[buckets])])
                ends = np.cumsum(n)
                counts.append(n)
                means.append((sums[ends] - sums[ends - n]) // np.maximum(n, 1))
            n, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, means))
            score = weight + np.array([noise(k, seed) for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(weight), pa.array(score), pa.array((n + 1) // 2 >= least_words)], ["doc_id", "n_features", "weight", "score", "eligible"])

    return mapped(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")), run, "doc_id long, n_features long, weight long, score long, eligible boolean")


class Tournament:
    """A tree of losers over sorted runs of keys: `winner` holds the run whose next key is smallest, ties to the earlier run."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.losers = [-1] * self.size
        won = [*([-1] * self.size), *(i if i < len(runs) and runs[i] else -1 for i in range(self.size))]
        for node in range(self.size - 1, 0, -1):
            won[node], self.losers[node] = self._match(won[2 * node], won[2 * node + 1])
        self.winner = won[1]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        if a < 0 or b < 0:
            return max(a, b), -1
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (a, b) if (x, a) <= (y, b) else (b, a)

    def __iter__(self):
        """(run, place in it) of all keys in order."""
        while self.winner >= 0:
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            best, node = run if self.at[run] < len(self.runs[run]) else -1, (run + self.size) >> 1
            while node:
                best, self.losers[node] = self._match(best, self.losers[node])
                node >>= 1
            self.winner = best


def merged(runs: list[np.ndarray], most: int | None = None, fan_in: int = FAN_IN) -> np.ndarray:
    """Sorted runs of records as one, in passes of trees of `fan_in` runs; the last pass ends when records of `most` rows are out."""
    while len(runs) > fan_in:
        runs = [merged(runs[i : i + fan_in], None, fan_in) for i in range(0, len(runs), fan_in)]
    keys = [list(zip((-r["score"]).tolist(), r["nameless"].tolist(), r["doc_id"].tolist())) for r in runs]
    sizes, first = [r["n"].tolist() for r in runs], np.cumsum([0, *map(len, runs)])
    order, out = [], 0
    for run, at in Tournament(keys):
        if most is not None and out >= most:
            # what the draw leaves out keeps its run's order
            taken = np.zeros(first[-1], bool)
            taken[order] = True
            order += np.flatnonzero(~taken).tolist()
            break
        order.append(int(first[run]) + at)
        out += sizes[run][at]
    return np.concatenate(runs)[np.array(order, np.int64)] if runs else np.zeros(0, _RECORD)


def cut(counts: list[tuple[int, int, int]], draw: int, size: int = RANGE) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (highest score, first slice, rank before the range, rows of it to draw) of neighbours in falling order of score and rising
    order of slice, from (score, slice, rows) of all eligible rows; and the lowest score that the draw reaches."""
    out, before, held, lowest = [], 0, None, 0
    for score, part, n in counts:
        if before >= draw:
            break
        if held is None or held >= size or held + n > size:
            out.append([score, part, before, 0])
            held = 0
        out[-1][3] += min(n, draw - before)
        held += n
        before += n
        lowest = score
    return [tuple(x) for x in out], lowest


def resampled(df: DataFrame, key: str, text: str, target: DataFrame, target_text: str, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, size: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, SCHEMA) for each row of df: rank is 1, 2, 3 ... in the order of the draw, null for what is not drawn."""
    weights = gains(bucket_counts(df, text), bucket_counts(target, target_text))
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    runs = checkpointed(scored(df, key, text, weights, least_words, seed).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()))
    eligible = runs.where("eligible")

    counted = {r[0]: (r[1], r[2], r[3]) for r in eligible.groupBy("score").agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()}
    total = sum(n for n, _, _ in counted.values())
    draw = percent * total // 100
    # scores with more rows than a range are cut by doc_id: (lowest id, width of a slice)
    large = {s: (lo, max(1, -(-(hi - lo + 1) // SLICES))) for s, (n, lo, hi) in counted.items() if n > size and lo is not None}
    parts = [(s, 0, n) for s, (n, _, _) in counted.items() if s not in large]
    if large:
        low, width = (F.coalesce(*[F.when(F.col("score") == s, F.lit(float(v[i]))) for s, v in large.items()]) for i in (0, 1))
        sliced = F.coalesce(F.floor((F.col("doc_id").cast("double") - low) / width), F.lit(SLICES))
        parts += [(r[0], r[1], r[2]) for r in eligible.where(F.col("score").isin(list(large))).groupBy("score", sliced.alias("slice")).count().collect()]
    ranges, lowest = cut(sorted(parts, key=lambda x: (-x[0], x[1])), draw, size)
    if not ranges:
        return runs.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))

    firsts, plan = [(-s, p) for s, p, _, _ in ranges], ranges

    def scatter(batches):
        seen: dict[int, int] = {}
        for b in batches:
            columns = [b.column(i).fill_null(0).to_numpy() for i in range(4)]
            run, nameless = b.column(4).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc, n_features, weight, score = columns
            part = np.zeros(len(doc), np.int64)
            for s, (lo, width) in large.items():
                here = score == s
                part[here] = np.where(nameless[here], SLICES, np.floor((doc[here].astype(np.float64) - float(lo)) / float(width)))
            records = np.zeros(len(doc), _RECORD)
            for name, values in (("score", score), ("nameless", nameless), ("doc_id", doc), ("n_features", n_features), ("weight", weight), ("n", 1)):
                records[name] = values
            # the last range that begins at or before (score, slice)
            where = np.array([bisect_right(firsts, (-s, p)) - 1 for s, p in zip(score.tolist(), part.tolist())], np.int64)
            rows = []
            for a, z in _stretches(where, run):
                mine = records[a:z]
                new = np.ones(len(mine), bool)
                new[1:] = mine[1:] != mine[:-1]
                starts = np.flatnonzero(new)
                folded = mine[starts]
                folded["n"] = np.diff([*starts, len(mine)])
                r = int(run[a])
                rows.append((int(where[a]), r, seen.get(r, 0), folded.tobytes()))
                seen[r] = seen.get(r, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["range", "run", "place", "stretch"])

    def merge(batches):
        for number, stretches in _by_range(batches):
            _, _, before, most = plan[number]
            found = merged(stretches, most, fan_in)
            ends = np.cumsum(found["n"])
            first = ends - found["n"]
            drawn = np.clip(most - first, 0, found["n"])
            columns = [pa.array(found["doc_id"], mask=found["nameless"] == 1), *(pa.array(found[c]) for c in ("n_features", "weight", "score")), pa.array(before + first + 1), pa.array(drawn), pa.array(found["n"] - drawn)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_features", "weight", "score", "first", "drawn", "rest"]
    sent = mapped(eligible.where(F.col("score") >= lowest).select("doc_id", "n_features", "weight", "score", "run"), scatter, "range long, run int, place long, stretch binary")
    dealt = sent.repartition(min(len(ranges), partitions(df.sparkSession)), "range").sortWithinPartitions("range", "run", "place")
    records = mapped(dealt, merge, "doc_id long, n_features long, weight long, score long, first long, drawn long, rest long")
    rank = F.explode(F.concat(F.when(F.col("drawn") > 0, F.sequence("first", F.col("first") + F.col("drawn") - 1)).otherwise(F.array().cast("array<long>")), F.array_repeat(F.lit(None).cast("long"), F.col("rest").cast("int"))))
    reached = records.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    rest = runs.where(~F.col("eligible") | (F.col("score") < lowest))
    return reached.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def _stretches(where: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a batch that lie in one range and one run."""
    cuts = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(run) != 0)) + 1).tolist(), len(where)]
    return [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]


def _by_range(batches):
    """(range, its stretch of each run); rows come sorted by range, run and place."""
    now, held, last = None, [], None
    for b in batches:
        for number, run, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if number != now:
                if held:
                    yield now, [np.concatenate(x) for x in held]
                now, held, last = number, [], None
            if run != last:
                held.append([])
                last = run
            held[-1].append(np.frombuffer(raw, _RECORD))
    if held:
        yield now, [np.concatenate(x) for x in held]


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


#: crc32 by its table of 256 remainders, over the bytes of each distinct feature.
ORACLE = rf"""
WITH remainders AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS r FROM range(256) t(b)
), w AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), p AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS p FROM w
), f AS (
  SELECT side, doc_id, unnest(p) AS f FROM p
  UNION ALL SELECT side, doc_id, p[i] || ' ' || p[i + 1] FROM (SELECT side, doc_id, p, unnest(range(1, len(p))) AS i FROM p)
), bytes AS (
  SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM f)
), buckets AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c // 256, r[xor(c % 256, x) + 1]), 4294967295), 4294967295) % {BUCKETS} AS k FROM bytes, remainders
), counted AS (
  SELECT k, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN buckets USING (f) GROUP BY k
), sums AS (
  SELECT CAST(sum(s) AS DOUBLE) + {BUCKETS} AS ss, CAST(sum(t) AS DOUBLE) + {BUCKETS} AS tt FROM counted
), gain AS (
  SELECT k, CAST(floor(1000 * ln((t + 1)::DOUBLE * ss / ((s + 1)::DOUBLE * tt))) AS BIGINT) AS g FROM counted, sums
), weighed AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN buckets USING (f) JOIN gain USING (k) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE (n_features + 1) // 2 >= {LEAST_WORDS}
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
