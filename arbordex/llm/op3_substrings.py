"""Operator 3, substring dedup by difference-cover anchors.

A window is LENGTH consecutive words of one document. PERIOD and COVER are a perfect difference set: for any two places
there is a shift below PERIOD that brings both to a place in COVER. So two equal windows share an equal run of
LENGTH - PERIOD + 1 words that begins at a cover place in both.

1. Hash the run at each cover place, and find the hashes that two documents share (anchors).
2. Extend: hash every window that holds an anchor whole, and find for each hash the smallest document.
3. Remove the words of the windows that a smaller document has too.

A batch settles by itself what its own documents share and sends one record of a hash, so a passage that a third of all
documents hold costs a reducer one record for each batch. Hashes have 64 bits; those of windows also meet only within
their bucket.

Null or empty text: no words. Fewer words than LENGTH: nothing is removed. A window that repeats within its own document only
stays. A null doc_id is larger than any other. Rows that share a doc_id, or have none, are documents of their own, and none of
them is smaller than another; each row gives one row. Other columns of the input may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import Rolling, Words, buffers, groups, passes, ranges
from arbordex.llm.packed import bucket_of, regroup, spread, unpack
from arbordex.llm.tables import mapped, table, texts

LENGTH = 50
PERIOD = 31
#: The perfect difference set modulo 31 (every remainder but 0 is one difference of two of them).
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = LENGTH - PERIOD + 1
_covered = np.zeros(PERIOD, bool)
_covered[list(COVER)] = True


def settle_shared(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shared, first): for each record in the order, whether its key has two documents here, and whether it is the
    first record of its key."""
    order, starts = groups(key, doc)
    k, d = key[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    which = np.cumsum(new_key) - 1
    changes = np.zeros(len(k), bool)
    changes[1:] = (d[1:] != d[:-1]) & ~new_key[1:]
    shared = np.bincount(which, weights=changes)[which] > 0 if len(k) else changes
    return order, shared, new_key


def map_anchors(b: pa.RecordBatch, buckets: int):
    """Records (key, row, place, state): 0 asks, 1 is known to be shared, 2 only says that its document has the key."""
    data, offsets = buffers(b.column(2))
    ids, keys, docs, places = b.column(0).to_numpy(), [], [], []
    for first, end, part, at in passes(data, offsets):
        words = Words(part, at)
        n = words.counts()
        full = np.where(n >= LENGTH, np.maximum(n - ANCHOR + 1, 0), 0)
        row, place = np.repeat(np.arange(len(n)), full), ranges(full)
        pick = _covered[place % PERIOD]
        row, place = row[pick], place[pick]
        start = words.first[row] + place
        keys.append(Rolling(words.hashes).of(start, start + ANCHOR))
        docs.append(ids[first:end][row])
        places.append(place.astype(np.int32))
    if not keys:
        return
    key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
    order, shared, first_of_key = settle_shared(key, doc)
    key, doc, place = key[order], doc[order], place[order]
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    ask, known, witness = ~shared, shared, shared & first_of_key
    bucket = np.concatenate([bucket_of(key[ask], buckets), spread(doc[known], buckets), bucket_of(key[witness], buckets)])
    state = np.repeat(np.array([0, 1, 2], np.uint8), [ask.sum(), known.sum(), witness.sum()])
    every = [np.concatenate([c[ask], c[known], c[witness]]) for c in (low, doc, place)]
    yield bucket, [*every, state]


def reduce_anchors(columns: list[np.ndarray]):
    """(doc, place) of the shared anchors."""
    key, doc, place, state = columns
    known = state == 1
    yield doc[known], [place[known]]
    key, doc, place, state = (c[~known] for c in columns)
    order, shared, _ = settle_shared(key, doc)
    # a witness stands for two documents of its batch
    order_state = state[order]
    _, starts = groups(key[order])
    witnessed = np.repeat(np.maximum.reduceat(order_state, starts) if len(starts) else order_state, np.diff([*starts, len(order)])) == 2
    flagged = (shared | witnessed) & (order_state == 0)
    yield doc[order][flagged], [place[order][flagged]]


def _candidates(n: int, anchors: np.ndarray, length: int, width: int) -> np.ndarray:
    """The window starts of a document of n units whose window holds an anchor of `width` units."""
    delta = np.zeros(n + 2, np.int32)
    np.add.at(delta, np.maximum(anchors + width - length, 0), 1)
    np.add.at(delta, np.minimum(anchors, n - length) + 1, -1)
    return np.flatnonzero(np.cumsum(delta[: max(n - length + 1, 0)]) > 0)


def map_windows(b: pa.RecordBatch, buckets: int):
    """Records (key, nameless, doc, row, place, state) of the windows that hold an anchor: state 1 is known to be removed."""
    data, offsets = buffers(b.column(2))
    rows, found = b.column(0).to_numpy(), b.column(3).to_pylist()
    nameless, docs = b.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.uint8), b.column(1).fill_null(0).to_numpy()
    keys, owners, places = [], [], []
    for first, end, part, at in passes(data, offsets):
        if not any(found[first:end]):
            continue
        words = Words(part, at)
        n, rolling = words.counts().tolist(), Rolling(words.hashes)
        for i in range(end - first):
            if found[first + i] and n[i] >= LENGTH:
                place = _candidates(n[i], unpack(found[first + i], ["<i4"])[0], LENGTH, ANCHOR)
                start = words.first[i] + place
                keys.append(rolling.of(start, start + LENGTH))
                owners.append(np.full(len(place), first + i))
                places.append(place.astype(np.int32))
    if not keys:
        return
    key, owner, place = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
    columns = [key, nameless[owner], docs[owner], rows[owner], place]
    order, larger = _larger(*columns[:3])
    columns, known = [c[order] for c in columns], larger
    bucket = np.where(known, spread(columns[3], buckets), bucket_of(columns[0], buckets))
    yield bucket, [*columns, known.astype(np.uint8)]


def _larger(key: np.ndarray, nameless: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, larger): an order by key and document, and for each record in it whether its key has a smaller document."""
    order = np.lexsort((doc, nameless, key))
    key, nameless, doc = key[order], nameless[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
    return order, (doc != doc[least]) | (nameless != nameless[least])


def reduce_windows(columns: list[np.ndarray]):
    """(row, place) of the windows that a smaller document has too."""
    known = columns[5] == 1
    yield columns[3][known], [columns[4][known]]
    key, nameless, doc, row, place, _ = (c[~known] for c in columns)
    order, larger = _larger(key, nameless, doc)
    yield row[order][larger], [place[order][larger]]


def removed(docs: DataFrame) -> DataFrame:
    """`texts` with `found`: the packed starts of the windows to remove."""
    anchors = regroup(docs, map_anchors, ["<u4", "<i8", "<i4", "u1"], reduce_anchors, ["<i4"])
    held = docs.join(anchors, "row", "left")
    return docs.join(regroup(held, map_windows, ["<u8", "u1", "<i8", "<i8", "<i4", "u1"], reduce_windows, ["<i4"]), "row", "left")


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a run of `length` that begins at one of `starts`."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, np.minimum(starts, n), 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:n]) > 0


def deduplicated(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row; kept words are joined by one space."""

    def run(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for t, found in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist()):
                words = t.split()
                total.append(len(words))
                if found:
                    drop = covered(len(words), unpack(found, ["<i4"])[0], LENGTH)
                    gone.append(int(drop.sum()))
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return mapped(removed(texts(df, key, text)), run, "doc_id long, n_words long, n_removed long, kept_text string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS p FROM documents
), starts AS (
  SELECT doc_id, i, md5(array_to_string(p[i:i + 49], ' ')) AS k FROM (SELECT doc_id, p, unnest(range(1, len(p) - 48)) AS i FROM w)
), first AS (
  SELECT k, min(doc_id) AS least FROM starts GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM starts JOIN first USING (k) WHERE doc_id > least
), words AS (
  SELECT doc_id, unnest(p) AS word, generate_subscripts(p, 1) AS j FROM w
), kept AS (
  SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(p) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
