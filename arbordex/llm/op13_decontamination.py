"""Operator 13, benchmark decontamination: Wu-Manber search for many test strings at once.

A test string is a window of LENGTH consecutive words of a benchmark item (of all words where it has fewer, but some), written as its
words between single spaces with a space before and after; a document is written the same way, so a test string occurs in it exactly
where its words stand in a row. Test strings are searched in classes of like length. In a class, the first m bytes of every string
count (m: the shortest length) in blocks of `block` bytes:

1. the shift table says, by a block's hash, how far the search may move on after seeing that block: m - block where no string has it,
   less where one has it nearer its end. Most places of a text are never looked at.
2. where the shift is 0, the block's hash chooses a bucket of test strings that may end there; of these the ones whose first block is
   there too are compared with the text byte by byte.

The search runs over many stretches of a text side by side in numpy. Tables of at most SLICE_BYTES of distinct test strings are
broadcast; a larger benchmark is taken in slices of that size, one pass over the documents for each, whose marks are kept in the
checkpoint folder in between. So the driver holds one slice of test strings at a time, and the result is the same.

A-Z are lower-cased; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Null or empty text, or one without words: no words, not contaminated;
an item without words marks nothing. Items that share an id are one item; an item without an id marks words but is not counted or
listed. Rows that share a doc_id, or have none, are documents of their own, and each row gives one row. An empty benchmark leaves all
documents clean. Other columns of the inputs may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import buffers, passes, ranges
from arbordex.llm.tables import checkpointed, mapped, table

LENGTH = 10
#: Bytes of distinct test strings, with the ids of their items, that one slice of tables may have.
SLICE_BYTES = 32 << 20
#: Test strings of at least so many bytes are one class; shorter ones are classed by powers of two.
LONG = 24
BLOCK = 8
#: Bytes of text that one lane of the search covers, and candidate pairs compared at once.
LANE = 512
PAIRS = 1 << 18
#: Bytes of text that one pass takes on; a longer text is a pass of its own.
PASS = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Plain:
    """Texts as words between single spaces: `data`, in which each text begins and ends with a space; `starts`, where words begin in
    it; `first`, for each text the number of its first word, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = np.zeros(n + 1, bool)
        solid[:-1] = _WORD[data]
        begins = solid[:-1].copy()
        begins[1:] &= ~solid[:-2]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] |= solid[edges]
        at = np.flatnonzero(begins)
        self.first = np.searchsorted(at, offsets)
        # each word takes its bytes and a space before it; two more spaces end each text
        kept = np.flatnonzero(solid[:-1])
        word_of = np.cumsum(begins)[kept] - 1
        text_of = np.searchsorted(self.first, np.arange(len(at)), "right") - 1
        place = np.arange(len(kept)) + word_of + 1 + 2 * text_of[word_of] if len(at) else kept
        size = len(kept) + len(at) + 2 * (len(offsets) - 1)
        self.size = size
        self.data = np.full(-(-size // 8) * 8 + 16, 32, np.uint8)
        self.data[place] = _LOWER[data[kept]]
        self.starts = place[np.searchsorted(kept, at)] if len(at) else np.zeros(0, np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` (at most 8) bytes at each place as one number; data is padded and a multiple of 8 bytes long."""
    aligned, q, r = data.view("<u8"), at >> 3, ((at & 7) << 3).astype(np.uint64)
    whole = (aligned[q] >> r) | ((aligned[q + 1] << (np.uint64(63) - r)) << np.uint64(1))
    return whole & np.uint64((1 << (8 * width)) - 1) if width < 8 else whole


class Searcher:
    """The tables of one class of test strings."""

    def __init__(self, strings: list[bytes], numbers: np.ndarray):
        self.least = min(map(len, strings))
        self.block = min(BLOCK, max(1, self.least // 2))
        self.deepest = self.least - self.block
        sizes = np.array([len(s) for s in strings])
        joined = b"".join(strings)
        data = np.frombuffer(joined + b" " * (24 - len(joined) % 8), np.uint8)
        at = np.cumsum(sizes) - sizes
        own = np.arange(self.deepest + 1)
        self.bits = max(10, int(4 * len(strings) + len(joined)).bit_length() + 1)
        self.shift = np.full(1 << self.bits, self.deepest + 1, np.int32)
        for k in own.tolist():  # later blocks shift less
            self.shift[self.hashed(blocks(data, at + k, self.block))] = self.deepest - k
        suffix = self.hashed(blocks(data, at + self.deepest, self.block))
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.numbers, self.sizes = suffix[order], numbers[order], sizes[order]
        self.prefix = blocks(data, at, self.block)[order]
        self.strings = [strings[i] for i in order.tolist()]

    def hashed(self, block: np.ndarray) -> np.ndarray:
        return ((block * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, text: Plain) -> np.ndarray:
        """The places where a test string may begin: those of shift 0, found by all lanes side by side."""
        at = np.arange(0, max(text.size - self.least + 1, 0), LANE)
        end, found = np.minimum(at + LANE, text.size - self.least + 1), []
        while len(at):
            step = self.shift[self.hashed(blocks(text.data, at + self.deepest, self.block))]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        return np.concatenate(found) if found else at

    def occurrences(self, text: Plain) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, test string) of all occurrences."""
        at = self.candidates(text)
        key = self.hashed(blocks(text.data, at + self.deepest, self.block))
        low, high = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, "right")
        front, raw = blocks(text.data, at, self.block), memoryview(text.data)
        cuts = np.searchsorted(np.cumsum(high - low), np.arange(PAIRS, (high - low).sum() + PAIRS, PAIRS), "right")
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
            # a single place may have more strings than PAIRS: they are compared step by step
            for lo in range(0, int((high - low)[a:b].max(initial=0)), PAIRS):
                part = np.clip(high[a:b] - low[a:b] - lo, 0, PAIRS)
                where, which = np.repeat(np.arange(a, b), part), np.repeat(low[a:b] + lo, part) + ranges(part)
                same = self.prefix[which] == front[where]
                where, which = at[where[same]], which[same]
                true = [raw[p : p + n] == self.strings[w] for p, n, w in zip(where.tolist(), self.sizes[which].tolist(), which.tolist())]
                yield where[true], which[true]


class Tables:
    """A slice of the test strings: their searchers, and for each string its number of words and the ids of its items."""

    def __init__(self, strings: list[bytes], items: list[list[str]]):
        self.items = items
        self.words = np.array([s.count(b" ") - 1 for s in strings], np.int64)
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            classes.setdefault(min(len(s), LONG) if len(s) >= LONG else 1 << (len(s).bit_length() - 1), []).append(i)
        self.searchers = [Searcher([strings[i] for i in some], np.array(some)) for _, some in sorted(classes.items())]

    def search(self, text: Plain) -> tuple[np.ndarray, list[set[int]]]:
        """(whether each word is hit, the numbers of the test strings in each text)."""
        delta = np.zeros(len(text.starts) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(text.first) - 1)]
        for s in self.searchers:
            for place, which in s.occurrences(text):
                number, word = s.numbers[which], np.searchsorted(text.starts, place)
                np.add.at(delta, word, 1)
                np.add.at(delta, word + self.words[number], -1)
                owner = np.searchsorted(text.first, word, "right") - 1
                for d, n in np.unique(np.stack([owner, number]), axis=1).T.tolist():
                    found[d].add(n)
        return np.cumsum(delta[:-1]) > 0, found


def test_strings(items: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(string binary, items array<string>): the distinct windows of the items' texts, and the items that have them."""

    def run(batches):
        for b in batches:
            strings, owners = [], []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                plain = Plain(raw, np.array([0, len(raw)]))
                n = len(plain.starts)
                ends = np.append(plain.starts[1:], plain.size - 1)
                width = min(n, length)
                data = plain.data.tobytes()
                windows = {data[plain.starts[i] - 1 : ends[i + width - 1]] for i in range(n - width + 1)} if n else set()
                strings += windows
                owners += [k] * len(windows)
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(owners, pa.string())], ["string", "item"])

    made = mapped(items.select(items[text].alias("text"), items[key].cast("string").alias("item")), run, "string binary, item string")
    return made.groupBy("string").agg(F.sort_array(F.collect_set("item")).alias("items"))


def slices(strings: DataFrame, most: int = SLICE_BYTES) -> Iterator[Tables]:
    """Tables of at most about `most` bytes each; strings are dealt to slices by hash."""
    size = F.octet_length("string") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)) + 16
    total = strings.agg(F.sum(size)).first()[0] or 0
    n = -(-total // most)
    if n > 1:
        strings = checkpointed(strings)
    for i in range(n):
        part = strings if n == 1 else strings.where(F.pmod(F.xxhash64("string"), F.lit(n)) == i)
        got = sorted((r["string"], r["items"]) for r in part.toArrow().to_pylist())
        if got:
            yield Tables([s for s, _ in got], [x for _, x in got])


def _marked(df: DataFrame, tables: Tables) -> DataFrame:
    """df (c0, text, hit binary, items array<string>) with the slice's hits and items added; `hit` has a bit for each word."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for b in batches:
            hits, items = [], []
            old_hits, old_items = b.column(2).to_pylist(), b.column(3).to_pylist()
            data, offsets = buffers(b.column(1))
            for first, _, part, at in passes(data, offsets, PASS):
                plain = Plain(part, at)
                hit, found = shared.value.search(plain)
                for i, (x, y) in enumerate(zip(plain.first.tolist(), plain.first.tolist()[1:])):
                    mine = np.packbits(hit[x:y]).tobytes() if found[i] else None
                    if mine and old_hits[first + i]:
                        mine = (np.frombuffer(mine, np.uint8) | np.frombuffer(old_hits[first + i], np.uint8)).tobytes()
                    hits.append(mine or old_hits[first + i])
                    items.append(sorted({x for n in found[i] for x in shared.value.items[n]}.union(old_items[first + i])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["c0", "text", "hit", "items"])

    return mapped(df, run, df.schema)


def contaminated(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, length: int = LENGTH, most: int = SLICE_BYTES) -> DataFrame:
    """(key, SCHEMA) for each row of df, after searching its whole text for the windows of all items."""
    marks = df.select(df[key].alias("c0"), df[text].alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    last = None
    for tables in slices(test_strings(items, item_key, item_text, length), most):
        marks = checkpointed(last) if last is not None else marks
        last = marks = _marked(marks, tables)

    def run(batches):
        for b in batches:
            words, rows = [], []
            data, offsets = buffers(b.column(1))
            for _, _, part, at in passes(data, offsets, PASS):
                words += Plain(part, at).counts().tolist()
            for hit, some in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                n = int.from_bytes(hit or b"", "big").bit_count()
                rows.append((n, len(some), hashlib.sha256(",".join(some).encode()).hexdigest(), n > 0))
            n, k, digest, any_hit = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(digest, pa.string()), pa.array(any_hit, pa.bool_())], ["c0", *(f.split()[0] for f in SCHEMA.split(", "))])

    return mapped(marks, run, f"c0 {dict(df.dtypes)[key]}, {SCHEMA}").withColumnRenamed("c0", key)


def clean(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, length: int = LENGTH, most: int = SLICE_BYTES) -> DataFrame:
    """The rows of df that have no window of an item, unchanged."""
    columns = {c: f"own_{i}" for i, c in enumerate(df.columns)}
    whole = df.select(F.struct(*[df[c].alias(n) for c, n in columns.items()]).alias("row"), df[text].alias("text"))
    found = contaminated(whole, "row", "text", items, item_key, item_text, length, most)
    return found.where("not contaminated").select(*[F.col(f"row.{n}").alias(c) for c, n in columns.items()])


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text", items, "item_id", "text")


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS p FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS p FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(p), {LENGTH}) AS n, array_to_string(p[i : i + least(len(p), {LENGTH}) - 1], ' ') AS s
  FROM (SELECT item_id, p, unnest(range(1, len(p) - least(len(p), {LENGTH}) + 2)) AS i FROM b WHERE len(p) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(p[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM windows))
), found AS (
  SELECT doc_id, item_id, places.n, i FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(p) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
