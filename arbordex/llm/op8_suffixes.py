"""Operator 8, suffix-array dedup: prefixes of sampled suffixes, ranked at growing lengths until unique or past the threshold.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in this document or another.

Doubling from every byte takes a record for each byte and round; the README has the figures that keep it from passing. So suffixes are
sampled by content: a position is an anchor if its GRAM-byte hash is the least of some run of SPREAD positions of its document. Every
LENGTH-byte string holds two anchors that its own bytes decide. Three rounds rank prefixes of growing length; a rank is a 64-bit hash
of the bytes, so the rank of a longer prefix needs no answer about the shorter one, and only whether a rank is unique has to travel:

1. The stretch from an anchor through the next one (about 60 bytes).
2. The pair of that rank and the rank of its surroundings, all strings of LENGTH bytes that hold the stretch (about 340 bytes). Spark
   deals and sorts the pairs by bucket; pairs of one bucket are sorted as numbers. A stretch that occurs once drops out with every
   string through it. Surroundings that occur twice are past the threshold: all their strings repeat.
3. Where a stretch repeats in different surroundings, the strings of LENGTH bytes through it, one by one, but for those that hold
   another stretch, decided by their own bytes, that occurs once; of equal surroundings one occurrence speaks for all.

A batch settles what its own documents decide and sends one record of a rank, so hot passages cost a reducer one record for each batch.
A batch has at most FEW surroundings of a hot stretch settled this way; the strings of further ones are ranked one by one, with the
same result.

Null or empty text, and texts shorter than LENGTH bytes: nothing is removed. Rows that share a doc_id, or have none, are documents of
their own; of a row that occurs twice every byte repeats elsewhere, so texts of LENGTH bytes or more lose everything. Other columns of
the input may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import Rolling, buffers, byte_values, passes
from arbordex.llm.packed import bucket_of, regroup, spread, unpack
from arbordex.llm.tables import mapped, one_row_each, table, texts

LENGTH = 200
GRAM = 16
#: Two disjoint runs of this many gram positions fit into LENGTH bytes.
SPREAD = (LENGTH - GRAM + 1) // 2
FEW = 64
BULK, EMIT = 1, 2
_FOUND = ["<i4", "u1", "u1"]


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """The places, in order, of the anchors of several texts; texts shorter than LENGTH have none."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    grams = _grams(rolling, at)
    least = _slide(grams, SPREAD, np.minimum)
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least))
    size = np.repeat(np.diff(offsets), np.diff(offsets))[: len(least)]
    least[(room < SPREAD + GRAM - 1) | (size < LENGTH)] = 0
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint32), least, np.zeros(SPREAD - 1, np.uint32)])
    return np.flatnonzero((_slide(padded, SPREAD, np.maximum) == grams) & (grams > 0))


def _grams(rolling: Rolling, at: np.ndarray) -> np.ndarray:
    return (rolling.of(at, at + GRAM) >> np.uint64(32)).astype(np.uint32)


def _surroundings(place: np.ndarray, reach: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in a text of n bytes, of all strings of LENGTH bytes that hold the stretch at `place` of `reach` bytes."""
    return np.maximum(place + reach - LENGTH, 0), np.minimum(place + LENGTH, n)


def _classes(name: np.ndarray, around: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted records: whether each begins a name and a class (name, surroundings), its class, and the class's distinct places."""
    new_name, new_place = np.ones(len(name), bool), np.ones(len(name), bool)
    new_name[1:] = name[1:] != name[:-1]
    new_class = new_name.copy()
    new_class[1:] |= around[1:] != around[:-1]
    new_place[1:] = new_class[1:] | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    of = np.cumsum(new_class) - 1
    return new_name, new_class, of, np.bincount(of, weights=new_place)[of]


def map_stretches(b: pa.RecordBatch, buckets: int):
    """Records (stretch, surroundings, doc, place, reach, state); state 0 asks, 1 and 3 know that all strings repeat and that they
    are to be ranked, 2 stands for two or more equal surroundings."""
    data, offsets = buffers(b.column(2))
    ids, parts = b.column(0).to_numpy(), []
    for first, end, part, at in passes(data, offsets):
        rolling = Rolling(byte_values(part))
        places = anchors(part, at, rolling)
        if len(places) < 2:
            continue
        row = np.searchsorted(at, places, side="right") - 1
        same = row[1:] == row[:-1]
        a, z, row = places[:-1][same], places[1:][same] + GRAM, row[:-1][same]
        start, stop = _surroundings(a - at[row], z - a, np.diff(at)[row])
        parts.append((rolling.of(a, z), rolling.of(at[row] + start, at[row] + stop), ids[first:end][row], (a - at[row]).astype(np.int32), (z - a).astype(np.uint8), start.astype(np.int32)))
    if not parts:
        return
    name, around, doc, place, reach, start = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((start, doc, around, name))
    new_name, new_class, of, spots = _classes(name[order], around[order], doc[order], start[order])
    many = spots > 1
    # a stretch that occurs twice within the same surroundings: only ranks tell which of their strings repeat
    twin = ~many & (np.bincount(of)[of] > 1)
    beyond = of - of[np.flatnonzero(new_name)][np.cumsum(new_name) - 1] >= FEW
    picks = [np.sort(order[p]) for p in (new_class & ~many & ~beyond, many, new_class & many & ~beyond, (new_class & beyond) | twin)]
    states = np.repeat(np.array([0, 1, 2, 3], np.uint8), [len(p) for p in picks])
    bucket = np.concatenate([(bucket_of(name[p], buckets), spread(doc[p], buckets))[k % 2] for k, p in enumerate(picks)])
    pick = np.concatenate(picks)
    yield bucket, [(name[pick] & np.uint64(0xFFFFFFFF)).astype(np.uint32), around[pick], doc[pick], place[pick], reach[pick], states]


def reduce_stretches(columns: list[np.ndarray]):
    """(doc, place, reach, BULK or EMIT): stretches all of whose strings repeat, and those whose strings are to be ranked."""
    state = columns[5]
    for known, action in ((state == 1, BULK), (state == 3, EMIT)):
        yield columns[2][known], [columns[3][known], columns[4][known], np.full(known.sum(), action, np.uint8)]
    asked = (state == 0) | (state == 2)
    name, around, doc, place, reach, state = (c[asked] for c in columns)
    if not len(name):
        return
    start = np.maximum(place + reach - LENGTH, 0)
    order = np.lexsort((start, doc, around, name))
    doc, place, reach, state = (c[order] for c in (doc, place, reach, state))
    new_name, new_class, of, spots = _classes(name[order], around[order], doc, start[order])
    many = (spots > 1) | (np.bincount(of, weights=state == 2)[of] > 0)
    name_of = np.cumsum(new_name) - 1
    varied = np.bincount(name_of, weights=new_class)[name_of] > 1
    for pick, action in ((many & (state == 0), BULK), (varied & new_class, EMIT)):
        yield doc[pick], [place[pick], reach[pick], np.full(pick.sum(), action, np.uint8)]


def _starts(place: np.ndarray, reach: np.ndarray, n: int) -> np.ndarray:
    """Which places of a text of n bytes start a string of LENGTH bytes that holds one of the stretches."""
    start, end = _surroundings(place.astype(np.int64), reach.astype(np.int64), n)
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, end - LENGTH + 1, -1)
    return np.cumsum(delta[:n]) > 0


def _possible(emit: np.ndarray, places: np.ndarray, grams: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Those of the starts `emit` whose string may repeat: all stretches that its own bytes decide occur elsewhere.

    The least anchors of the string's first and last SPREAD positions are decided by its bytes, and so is all between them.
    """
    ends = []
    for first, side in ((emit, -1), (emit + LENGTH - GRAM + 1 - SPREAD, 1)):
        low, high = np.searchsorted(places, first), np.searchsorted(places, first + SPREAD)
        best, least = low.copy(), np.full(len(emit), 1 << 32, np.int64)
        for k in range(int((high - low).max(initial=0))):
            i = np.minimum(low + k, len(places) - 1)
            g = np.where(low + k < high, grams[i].astype(np.int64), 1 << 33)
            better = g < least if side < 0 else g <= least
            best, least = np.where(better, i, best), np.where(better, g, least)
        ends.append(best)
    sums = np.concatenate([[0], np.cumsum(shared)])
    first, last = ends
    return emit[(last > first) & (sums[last] - sums[first] == last - first)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def map_strings(b: pa.RecordBatch, buckets: int):
    """Records (rank, doc, start, size, state) of strings: 0 asks, 1 is known to repeat (a run of bytes), 2 stands for several."""
    data, offsets = buffers(b.column(2))
    ids, found = b.column(0).to_numpy(), b.column(3).to_pylist()
    ranked, known = [], []
    for first, end, part, at in passes(data, offsets):
        if not any(found[first:end]):
            continue
        rolling = Rolling(byte_values(part))
        every = anchors(part, at, rolling)
        cuts = np.searchsorted(every, at)
        for i in range(end - first):
            if found[first + i]:
                place, reach, action = unpack(found[first + i], _FOUND)
                n, doc = int(at[i + 1] - at[i]), ids[first + i]
                # rows that share an id but not a text may be shorter than the places say
                inside = (place.astype(np.int64) + reach <= n) & (n >= LENGTH)
                place, reach, action = place[inside], reach[inside], action[inside]
                bulk = _starts(place[action == BULK], reach[action == BULK], n)
                a, length = _runs(bulk)
                known.append((np.full(len(a), doc), a.astype(np.int32), (length + LENGTH - 1).astype(np.int32)))
                emit = np.flatnonzero(_starts(place[action == EMIT], reach[action == EMIT], n))
                if len(emit):
                    own = every[cuts[i] : cuts[i + 1]]
                    emit = _possible(emit, own - at[i], _grams(rolling, own), np.isin(own[:-1] - at[i], place))
                if len(emit):
                    ranked.append((rolling.of(at[i] + emit, at[i] + emit + LENGTH), np.full(len(emit), doc), emit.astype(np.int32), bulk[emit]))
    out: list[list[np.ndarray]] = []
    if known:
        doc, start, size = (np.concatenate(c) for c in zip(*known))
        out.append([spread(doc, buckets), np.zeros(len(doc), np.uint64), doc, start, size, np.ones(len(doc), np.uint8)])
    if ranked:
        rank, doc, start, sure = (np.concatenate(c) for c in zip(*ranked))
        order = np.argsort(rank, kind="stable")
        new = np.ones(len(rank), bool)
        new[1:] = rank[order][1:] != rank[order][:-1]
        of = np.cumsum(new) - 1
        many = (np.bincount(of)[of] > 1) | (np.bincount(of, weights=sure[order])[of] > 0)
        for pick, state in ((many & ~sure[order], 1), (~many, 0), (many & new, 2)):
            p = np.sort(order[pick])  # in the order of the documents, which packs best
            bucket = spread(doc[p], buckets) if state == 1 else bucket_of(rank[p], buckets)
            out.append([bucket, rank[p], doc[p], start[p], np.full(len(p), LENGTH, np.int32), np.full(len(p), state, np.uint8)])
    if out:
        bucket, *columns = (np.concatenate(c) for c in zip(*out))
        yield bucket, columns


def reduce_strings(columns: list[np.ndarray]):
    """(doc, start, size) of the runs of bytes to remove."""
    known = columns[4] == 1
    yield columns[1][known], [columns[2][known], columns[3][known]]
    rank, doc, start, size, state = (c[~known] for c in columns)
    if not len(rank):
        return
    order = np.argsort(rank, kind="stable")
    rank, doc, start, size, state = (c[order] for c in (rank, doc, start, size, state))
    new = np.ones(len(rank), bool)
    new[1:] = rank[1:] != rank[:-1]
    of = np.cumsum(new) - 1
    repeated = ((np.bincount(of)[of] > 1) | (np.bincount(of, weights=state == 2)[of] > 0)) & (state == 0)
    yield doc[repeated], [start[repeated], size[repeated]]


def deduplicated(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row."""
    docs = texts(df, key, text)
    stretches = regroup(docs, map_stretches, ["<u4", "<u8", "<i8", "<i4", "u1", "u1"], reduce_stretches, _FOUND)
    strings = regroup(docs.join(stretches, "row", "left"), map_strings, ["<u8", "<i8", "<i4", "<i4", "u1"], reduce_strings, ["<i4", "<i4"])
    again = docs.groupBy("row").count().where("count > 1").select("row", F.lit(True).alias("again"))
    if one_row_each(df, key):
        again = again.limit(0)

    def run(batches):
        for b in batches:
            rows = []
            for t, found, twice in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if twice and len(t) >= LENGTH:
                    rows.append((len(t), len(t), 1, b""))
                    continue
                if not found:
                    rows.append((len(t), 0, 0, t))
                    continue
                start, size = unpack(found, ["<i4", "<i4"])
                delta = np.zeros(len(t) + 1, np.int32)
                np.add.at(delta, np.minimum(start, len(t)), 1)
                np.add.at(delta, np.minimum(start + size, len(t)), -1)
                drop = np.cumsum(delta[: len(t)]) > 0
                rows.append((len(t), int(drop.sum()), len(_runs(drop)[0]), np.frombuffer(t, np.uint8)[~drop].tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    found = docs.join(strings, "row", "left").join(again, "row", "left")
    return mapped(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes by its md5: for small tables.
ORACLE = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b WHERE n >= 200)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM starts) WHERE c > 1
), placed AS (
  SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS apart, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS first FROM again
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(CASE WHEN apart OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM placed) GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
  SELECT doc_id, sum(z - a) AS removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(z) AS last FROM cuts JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""
