"""Operator 5, n-gram Jaccard join with a prefix tree.

A document's set holds its distinct shingles of SHINGLE words (A-Z lower-cased); fewer words make one shingle, no words none.
Two documents link if 100 * shared >= PERCENT * united. Every stage keeps every link between different sets:

1. Sets equal by a 128-bit digest are one; one document stands for them.
2. A set with a partner leaves at most a fifth of itself unshared. So of its n // 5 + 1 + n // 10 least hashes, more than n // 10
   occur in other sets. Sets that fail this have no partner.
3. The survivors' shingles are put into one global order, rare ones first. Linked sets share one of their first n // 5 + 1.
   Sets that share such a shingle, directly or through others, make a cluster.
4. Each cluster's sets go into a prefix tree, common shingles first so that near copies share long paths. A set walks down
   it, carries its overlap along and leaves subtrees that their sizes and remaining lengths rule out. Sets that are already
   connected are not compared for their own sake: walks go on until all sets that never walked are connected. Clusters of
   more than BLOCK sets are split into blocks that share a few sets. Sets that these leave apart then meet every block, or the
   sets that share a shingle of their rare beginnings with them, whichever sends fewer sets.
5. Links, equal sets and nothing else make the components.

A batch settles what its own documents decide and sends one record for each hash, so copies and common lines that fill a
third of the table cost a reducer one record a batch. Null or empty text: an empty set, linked with nothing. Each row is a
document of its own, also where rows share a doc_id or have none; a component's id is the smallest that a row of it has, null if
none has one. Other columns of the input may have any name.

BROADCAST_IDS, BLOCK and PIVOTS choose between ways to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import Rolling, Words, buffers, mix, passes, ranges
from arbordex.llm.graph import components
from arbordex.llm.op3_substrings import settle_shared
from arbordex.llm.packed import bucket_of, regroup, slices, spread, unpack
from arbordex.llm.tables import bucketed, checkpointed, dropped, mapped, one_row_each, partitions, table, texts

SHINGLE = 5
PERCENT = 80
BLOCK = 256
#: Sets of a large cluster that go into all of its blocks.
PIVOTS = 16
#: Ids of survivors that a broadcast may hold (32 MB); beyond that they are joined.
BROADCAST_IDS = 4_000_000
SIZE, SAME, SHARED = 0, 1, 2


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of each text's set, row of each shingle, its hash), in order of row and hash."""
    words = Words(data, offsets, lower=True)
    n = words.counts()
    full = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), full)
    start = words.first[row] + ranges(full)
    key = Rolling(words.hashes).of(start, start + np.minimum(n, SHINGLE)[row])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    row, key = row[new], key[new]
    return np.bincount(row, minlength=len(n)), row, key


def _unshared(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n a linked set may lack."""
    return n * (100 - PERCENT) // 100


def _sampled(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, _unshared(n) + 1 + n // 10)


def map_samples(b: pa.RecordBatch, buckets: int):
    """Records (key, more, row, n, kind): 0 size of a set, 1 and 2 a sampled shingle that asks or stands for several, 3 shingles
    known to be shared, 4 a digest, 5 a document equal to another of the batch (more)."""
    data, offsets = buffers(b.column(2))
    ids = b.column(0).to_numpy()
    sizes, digests, keys, owners, at0 = [], [], [], [], 0
    for first, end, part, at in passes(data, offsets):
        n, row, key = sets(part, at)
        sizes.append(n)
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        sums = np.zeros((2, len(n)), np.uint64)
        if len(key):
            full = np.flatnonzero(n)
            sums[0, full] = np.add.reduceat(mix(key), begin[full])
            sums[1, full] = np.add.reduceat(mix(key ^ np.uint64(0xA5A5A5A5DEADBEEF)), begin[full])
        digests.append(sums)
        pick = np.arange(len(key)) - begin[row] < _sampled(n)[row]
        keys.append(key[pick])
        owners.append(row[pick] + first)
    if not sizes:
        return
    n, (one, two) = np.concatenate(sizes), np.concatenate(digests, axis=1)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    stands = np.empty(len(order), np.int64)
    stands[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    own = (stands == np.arange(len(ids))) & (n > 0)
    copy = ~own & (n > 0)
    mine = own[owner]
    key, doc = key[mine], ids[owner[mine]]
    by, shared, first_of_key = settle_shared(key, doc)
    known = np.bincount(owner[mine][by][shared], minlength=len(ids))
    ask = np.zeros(len(key), bool)
    ask[by[~shared]] = True  # in the order of the documents, which packs best
    stand = by[shared & first_of_key]
    zero = np.zeros(0, np.uint64)
    have = np.flatnonzero(known)
    sections = [
        (spread(ids, buckets), np.zeros(len(ids), np.uint64), None, ids, n, 0),
        (bucket_of(key[ask], buckets), key[ask] & np.uint64(0xFFFFFFFF), None, doc[ask], None, 1),
        (bucket_of(key[stand], buckets), key[stand] & np.uint64(0xFFFFFFFF), None, doc[stand], None, 2),
        (spread(ids[have], buckets), zero, None, ids[have], known[have], 3),
        (bucket_of(one[own], buckets), one[own], two[own], ids[own], None, 4),
        (spread(ids[copy], buckets), zero, ids[stands[copy]].view(np.uint64), ids[copy], None, 5),
    ]
    for bucket, k, more, d, size, kind in sections:
        m = len(d)
        fill = lambda c, t: np.zeros(m, t) if c is None or len(c) != m else c.astype(t)
        yield bucket, [fill(k, np.uint64), fill(more, np.uint64), d, fill(size, np.int32), np.full(m, kind, np.uint8)]


def reduce_samples(columns: list[np.ndarray]):
    """(row, SIZE n), (row, SAME row of a smaller number with an equal set), (row, SHARED sampled shingles that others have)."""
    key, more, doc, n, kind = columns
    out = lambda d, what, value: (d, [np.full(len(d), what, np.uint8), value.astype(np.int64)])
    yield out(doc[kind == 0], SIZE, n[kind == 0])
    yield out(doc[kind == 3], SHARED, n[kind == 3])
    yield out(doc[kind == 5], SAME, more[kind == 5].view(np.int64))
    four = kind == 4
    k, m, d = key[four], more[four], doc[four]
    order = np.lexsort((d, m, k))
    k, m, d = k[order], m[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    if len(k):
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        yield out(d[d != least], SAME, least[d != least])
    asked = (kind == 1) | (kind == 2)
    k, d, stand = key[asked], doc[asked], kind[asked] == 2
    if len(k):
        by, shared, new = settle_shared(k, d)
        of = np.cumsum(new) - 1
        shared |= np.bincount(of, weights=stand[by])[of] > 0
        found, count = np.unique(d[by][shared & ~stand[by]], return_counts=True)
        yield out(found, SHARED, count)


def described(docs: DataFrame) -> DataFrame:
    """(row, n, same, shared) of each document, kept in the shared folder."""

    def run(batches):
        for b in batches:
            n, same, shared = [], [], []
            for found in b.column(1).to_pylist():
                what, value = unpack(found, ["u1", "<i8"])
                n.append(int(value[what == SIZE].max(initial=0)))
                equal = value[what == SAME]
                same.append(int(equal.min()) if len(equal) else None)
                shared.append(int(value[what == SHARED].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same, pa.int64()), pa.array(shared, pa.int64())], ["row", "n", "same", "shared"])

    found = regroup(docs, map_samples, ["<u8", "<u8", "<i8", "<i4", "u1"], reduce_samples, ["u1", "<i8"])
    return checkpointed(mapped(found, run, "row long, n long, same long, shared long"))


def survivor_sets(docs: DataFrame, info: DataFrame, most: int = BROADCAST_IDS) -> tuple[DataFrame, str]:
    """(row, hashes binary) of the sets that may have a partner, and the name of their table, which is bucketed by row, so that no
    join by row that follows exchanges the sets again. Up to `most` survivors are told to all tasks, more are joined."""
    unshared = F.floor(F.col("n") * (100 - PERCENT) / 100)
    sampled = F.least(F.col("n"), unshared + 1 + F.floor(F.col("n") / 10))
    chosen = info.where("same is null and n > 0").where(F.col("shared") >= sampled - unshared).select("row")
    rows = chosen.limit(most + 1).toArrow()["row"].to_numpy()
    if len(rows) <= most:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(rows))
    else:
        shared, docs = None, docs.join(chosen, "row", "left_semi")

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            if shared is not None:
                own = b.column(0).to_numpy()
                at = np.minimum(np.searchsorted(shared.value, own), max(len(shared.value) - 1, 0))
                b = b.filter(pa.array(shared.value[at] == own if len(shared.value) else np.zeros(len(own), bool)))
            data, offsets = buffers(b.column(2))
            blobs = []
            for _, _, part, at in passes(data, offsets):
                n, _, key = sets(part, at)
                cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
                blobs += [key[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["row", "hashes"])

    kept, name = bucketed(mapped(docs, run, "row long, hashes binary"), "row")
    try:
        # equal rows have equal sets, of which one stays
        again = kept.groupBy("row").count().where("count > 1").select("row")
        if not again.isEmpty():
            several = kept.join(again, "row", "left_semi").groupBy("row").agg(F.first("hashes").alias("hashes"))
            all_of_them = name
            kept, name = bucketed(kept.join(again, "row", "left_anti").unionByName(several), "row")
            dropped(docs.sparkSession, all_of_them)
    except BaseException:
        dropped(docs.sparkSession, name)
        raise
    if shared is not None:
        shared.unpersist()
    return kept, name


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, place in them of each hash's row, hashes) of a batch of survivors."""
    data, offsets = buffers(b.column(1))
    n = np.diff(offsets) // 8
    return b.column(0).to_numpy(), np.repeat(np.arange(len(n)), n), np.frombuffer(data.tobytes(), np.uint64)


def map_frequencies(b: pa.RecordBatch, buckets: int):
    """Records (key, doc, place, n): a shingle's place in its set; n > 0 says how many of the batch have it, without a place."""
    ids, row, key = _flat(b)
    begin = np.searchsorted(row, np.arange(len(ids)))
    place = (np.arange(len(key)) - begin[row]).astype(np.int32)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    yield bucket_of(key, buckets), [low, ids[row], place]


def reduce_frequencies(columns: list[np.ndarray]):
    """(doc, place, n): the shingles that n > 1 survivors have."""
    key, doc, place = columns
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    n = count[of]
    yield doc[n > 1], [place[n > 1], np.minimum(n[n > 1], 1 << 30).astype(np.int32)]


def beginnings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the shingles of each set's rare beginning that another survivor has."""
    found = b.column(2).to_pylist()
    rows, of, key = _flat(b.select([0, 1]))
    frequency = np.ones(len(key), np.int64)
    begin = np.searchsorted(of, np.arange(len(rows) + 1))
    for i, f in enumerate(found):
        if f:
            place, n = unpack(f, ["<i4", "<i4"])
            frequency[begin[i] + place] = n
    order = np.lexsort((key, frequency, of))
    first = np.arange(len(key)) - begin[of] <= _unshared(np.diff(begin))[of]
    pick = order[first & (frequency[order] > 1)]
    return key[pick], rows[of[pick]]


def _paired(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of each row with the least row of its key, keys, their least rows)."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    least = row[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else row
    return np.unique(np.stack([row[~new], least[~new]]), axis=1), key[new], row[new]


def map_prefixes(b: pa.RecordBatch, buckets: int):
    """Records (key, row, other, paired): a shingle of a set's rare beginning; or two rows of the batch that share one."""
    pairs, key, row = _paired(*beginnings(b))
    bucket = np.concatenate([bucket_of(key, buckets), spread(pairs[0], buckets)])
    zero = np.zeros(pairs.shape[1], np.uint64)
    yield bucket, [np.concatenate([key, zero]), np.concatenate([row, pairs[0]]), np.concatenate([np.zeros(len(row), np.int64), pairs[1]]), np.repeat(np.array([0, 1], np.uint8), [len(row), len(zero)])]


def reduce_prefixes(columns: list[np.ndarray]):
    """(row, smaller row) that share a shingle of both beginnings."""
    key, row, other, paired = columns
    paired = paired == 1
    yield row[paired], [other[paired]]
    pairs, _, _ = _paired(key[~paired], row[~paired])
    yield pairs[0], [pairs[1]]


def edges(found: DataFrame) -> DataFrame:
    """(a, b) of packed neighbours."""

    def run(batches):
        for b in batches:
            for row, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                other = np.unique(unpack(payload, ["<i8"])[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), row)), pa.array(other)], ["a", "b"])

    return mapped(found, run, "a long, b long")


def ranked(survivors: DataFrame) -> DataFrame:
    """(row, hashes, found): sets with how often each of their shingles occurs in all of them, which orders shingles alike for all."""
    return survivors.join(regroup(survivors, map_frequencies, ["<u4", "<i8", "<i4"], reduce_frequencies, ["<i4", "<i4"]), "row", "left")


def prefixes(ranked: DataFrame) -> DataFrame:
    """(row, key) of the rare beginnings of `ranked` (row, hashes, found)."""

    def run(batches):
        for b in batches:
            key, row = beginnings(b)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(key.view(np.int64))], ["row", "key"])

    return mapped(ranked, run, "row long, key long")


class PrefixTree:
    """A tree of sorted sets with one node for each run of shingles that the same sets go through."""

    def __init__(self, sets_: list[np.ndarray]):
        """sets_: ascending numbers, distinct sets."""
        order = sorted(range(len(sets_)), key=lambda i: sets_[i].astype(">u4").tobytes())
        start, end, parent, leaf, stack = [], [], [], [], [(-1, 0)]
        pool, at = [], 0
        before = np.zeros(0, np.int64)
        for i in order:
            s = sets_[i]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            last = None
            while stack[-1][1] > common:
                last = stack.pop()
            if stack[-1][1] < common:  # the node that ends beyond `common` is cut in two there
                node = last[0]
                cut = start[node] + common - stack[-1][1]
                upper = len(start)
                start.append(start[node])
                end.append(cut)
                parent.append(parent[node])
                leaf.append(-1)
                start[node], parent[node] = cut, upper
                stack.append((upper, common))
            start.append(at)
            end.append(at + len(s) - common)
            parent.append(stack[-1][0])
            leaf.append(i)
            stack.append((len(start) - 1, len(s)))
            pool.append(s[common:])
            at += len(s) - common
            before = s
        self.start, self.end, self.parent, self.leaf = map(np.array, (start, end, parent, leaf))
        self.tokens = np.concatenate(pool)
        n = len(start)
        self.depth = np.full(n, -1)
        children: list[list[int]] = [[] for _ in range(n + 1)]
        for node, p in enumerate(parent):
            children[p].append(node)
        self.low, self.high = np.full(n, 1 << 30), np.zeros(n, np.int64)
        top, seen = [children[n]], []
        while top:
            level = top.pop()
            for node in level:
                p = parent[node]
                self.depth[node] = (self.depth[p] if p >= 0 else 0) + end[node] - start[node]
                seen.append(node)
                if children[node]:
                    top.append(children[node])
        for node in reversed(seen):
            if leaf[node] >= 0:
                self.low[node] = min(self.low[node], self.depth[node])
                self.high[node] = max(self.high[node], self.depth[node])
            p = parent[node]
            if p >= 0:
                self.low[p], self.high[p] = min(self.low[p], self.low[node]), max(self.high[p], self.high[node])
        self.counts = np.array([len(c) for c in children[:n]])
        self.below = np.array([c for some in children[:n] for c in some], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.roots = np.array(children[n], np.int64)
        self.mark = np.zeros(int(self.tokens.max()) + 1, np.int64)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The leaves' sets that link with x."""
        self.mark[x] = 1
        nodes, overlap, out = self.roots, np.zeros(len(self.roots), np.int64), []
        while len(nodes):
            length = self.end[nodes] - self.start[nodes]
            tokens = self.tokens[np.repeat(self.start[nodes], length) + ranges(length)]
            overlap = overlap + np.add.reduceat(self.mark[tokens], np.cumsum(length) - length)
            rest = len(x) - np.searchsorted(x, self.tokens[self.end[nodes] - 1], side="right")
            most = overlap + np.minimum(rest, self.high[nodes] - self.depth[nodes])
            # linked: (100 + PERCENT) * shared >= PERCENT * (both sizes)
            alive = (100 + PERCENT) * most >= PERCENT * (len(x) + np.maximum(self.low[nodes], most))
            nodes, overlap = nodes[alive], overlap[alive]
            here = (self.leaf[nodes] >= 0) & ((100 + PERCENT) * overlap >= PERCENT * (len(x) + self.depth[nodes]))
            out.append(self.leaf[nodes[here]])
            k = self.counts[nodes]
            overlap = np.repeat(overlap, k)
            nodes = self.below[np.repeat(self.first[nodes], k) + ranges(k)]
        self.mark[x] = 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def linked(hashes: list[np.ndarray], groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough of them to connect what all links connect; `groups` says what is connected already."""
    first: dict[bytes, int] = {}
    same = [(i, j) for i, h in enumerate(hashes) if (j := first.setdefault(h.tobytes(), i)) != i]
    if same:
        own = list(first.values())
        return same + [(own[i], own[j]) for i, j in linked([hashes[i] for i in own], groups and [groups[i] for i in own])]
    n = len(hashes)
    if n < 2:
        return []
    flat = np.concatenate(hashes)
    _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    cuts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    ranked = [np.sort(rank[of[a:b]]) for a, b in zip(cuts, cuts[1:])]
    centre = np.add.reduceat(count[of], cuts[:-1]) / np.diff(cuts)
    tree, label, size, out = PrefixTree(ranked), np.arange(n), np.zeros(n, np.int64), []
    members: dict[int, list[int]] = {}
    for i, g in enumerate(groups or range(n)):
        members.setdefault(g, []).append(i)
    members = {some[0]: some for some in members.values()}
    for first, some in members.items():
        label[some], size[first] = first, len(some)
    waiting, largest = np.argsort(-centre, kind="stable").tolist(), int(size.argmax())
    while waiting:  # sets of the largest group may wait; those whose group is no longer the largest walk in the next turn
        later = []
        for i in waiting:
            if size[label[i]] > 1 and label[i] == largest:
                later.append(i)
                continue
            for j in tree.walk(ranked[i]).tolist():
                a, b = label[i], label[j]
                if a != b:
                    a, b = (a, b) if size[a] >= size[b] else (b, a)
                    label[members[b]] = a
                    members[a] += members.pop(b)
                    size[a] += size[b]
                    out.append((i, j))
                    if size[a] > size[largest] or largest == b:
                        largest = a
        waiting = [i for i in later if label[i] != largest]
    return out


def _tree_links(dealt: DataFrame, survivors: DataFrame) -> DataFrame:
    """(a, b): the links of each group (part, i, j) of `dealt` (row, part, i, j, known), where equal `known` are connected."""
    held = dealt.join(survivors, "row").repartition(partitions(survivors.sparkSession), "part", "i", "j").sortWithinPartitions("part", "i", "j", "row")

    def run(batches):
        def parts() -> Iterator[tuple[list[int], list[int], list[bytes]]]:
            key, rows, known, blobs = None, [], [], []
            for b in batches:
                for r, k, c, blob in zip(b.column(0).to_pylist(), zip(*(b.column(c).to_pylist() for c in (1, 2, 3))), b.column(4).to_pylist(), b.column(5).to_pylist()):
                    if k != key and rows:
                        yield rows, known, blobs
                        rows, known, blobs = [], [], []
                    key = k
                    rows.append(r)
                    known.append(c)
                    blobs.append(blob)
            if rows:
                yield rows, known, blobs

        for rows, known, blobs in parts():
            pairs = [(rows[x], rows[y]) for x, y in linked([np.frombuffer(h, np.uint64) for h in blobs], known)]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return mapped(held.select("row", "part", "i", "j", "known", "hashes"), run, "a long, b long")


def _blocks(of: str, block: int) -> Column:
    return F.ceil(F.col(of) / F.lit(block)).cast("int")


def links(survivors: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): linked `survivors` (row, hashes), enough of them to connect what all links connect; `clusters` (row, component) has
    each once.

    First each block of a cluster gets a tree, and about PIVOTS sets of a cluster with several blocks go into all its blocks.
    That connects almost all that is connected. Two linked sets that are not connected by then share a shingle of their rare
    beginnings and are not both in their cluster's largest group. So either the sets outside that group meet all blocks of the
    cluster, or they meet the sets that share such a shingle with them, shingle by shingle; a cluster takes the way that sends
    fewer sets, so one that boilerplate holds together does not compare all with all.
    """
    sizes = checkpointed(clusters.groupBy("component").agg(F.count("*").alias("size")).withColumn("blocks", _blocks("size", block)))
    placed = checkpointed(clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")))
    large = placed.where("blocks > 1")
    columns = ["row", "part", "i", "j", "known"]
    one = placed.select("row", F.col("component").alias("part"), F.col("own").alias("i"), F.lit(0).alias("j"), F.col("row").alias("known"))
    pivots = large.where(F.pmod(F.xxhash64("row", F.lit(1)), F.col("size")) < PIVOTS).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("i <> own")
    first = checkpointed(_tree_links(one.unionByName(pivots.select("row", F.col("component").alias("part"), "i", F.lit(0).alias("j"), F.col("row").alias("known"))), survivors))
    if large.isEmpty():
        return first
    known = large.join(components(first).select(F.col("id").alias("row"), F.col("component").alias("known")), "row", "left").withColumn("known", F.coalesce("known", "row"))
    known = checkpointed(known)
    groups = known.groupBy("component", "known").agg(F.count("*").alias("n"))
    largest = groups.groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("largest"), (F.sum("n") - F.max("n")).alias("outside_n"))
    largest = checkpointed(largest.where("outside_n > 0").withColumn("chunks", _blocks("outside_n", block)))
    if largest.isEmpty():
        return first
    known = checkpointed(known.join(largest, "component").select("row", "component", "known", "own", "blocks", "chunks", "size", "outside_n", (F.col("known") != F.col("largest")).alias("outside")))
    begun = checkpointed(prefixes(ranked(survivors.join(known.select("row"), "row", "left_semi"))).join(known.select("row", "component", "known", "outside"), "row"))
    shingles = begun.groupBy("component", "key").agg(F.count("*").alias("n"), F.count_if("outside").alias("outside_n"), F.min("known").alias("low"), F.max("known").alias("high"))
    shingles = checkpointed(shingles.where("outside_n > 0 and low <> high").withColumns({"blocks": _blocks("n", block), "chunks": _blocks("outside_n", block)}))
    # of the two ways each cluster takes the one that sends fewer sets
    rows = F.col("n") * F.col("chunks") + F.when(F.col("blocks") > 1, F.col("outside_n") * F.col("blocks")).otherwise(0)
    by_shingle = shingles.groupBy("component").agg(F.sum(rows).alias("by_shingle"))
    by_block = known.groupBy("component").agg(F.max(F.col("size") * F.col("chunks") + F.col("outside_n") * F.col("blocks")).alias("by_block"))
    ways = checkpointed(by_block.join(by_shingle, "component", "left").select("component", (F.coalesce("by_shingle", F.lit(0)) < F.col("by_block")).alias("shingled")))
    begun = begun.join(ways.where("shingled").select("component"), "component").join(shingles.select("component", "key", "blocks", "chunks"), ["component", "key"])
    begun = begun.select("row", F.xxhash64("component", "key").alias("part"), "known", "outside", "blocks", "chunks", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("own"))
    whole = known.join(ways.where("not shingled").select("component"), "component").select("row", F.col("component").alias("part"), "known", "outside", "blocks", "chunks", "own")
    dealt = checkpointed(begun.unionByName(whole))
    every = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.col("own"))
    outside = dealt.where("outside and blocks > 1").withColumn("j", F.pmod(F.xxhash64("row", F.lit(2)), F.col("chunks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a set comes into a block once: as one of it, or as an outside set that meets it
    outside = outside.where("i <> own")
    return first.unionByName(_tree_links(every.select(columns).unionByName(outside.select(columns)), survivors))


def related(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, n) of each of `texts`, (row, component) of each that is linked with another)."""
    info = described(docs)
    survivors, name = survivor_sets(docs, info)
    try:
        near = regroup(ranked(survivors), map_prefixes, ["<u8", "<i8", "<i8", "u1"], reduce_prefixes, ["<i8"])
        found = links(survivors, components(edges(near)).withColumnRenamed("id", "row"))
        equal = info.where("same is not null").select(F.col("row").alias("a"), F.col("same").alias("b"))
        groups = components(found.unionByName(equal)).withColumnRenamed("id", "row")
    finally:
        dropped(docs.sparkSession, name)  # components are kept, nothing reads the sets any more
    return info.select("row", "n"), groups


def joined(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    docs = texts(df, key, text)
    info, groups = related(docs)
    ids = docs.select("row", "doc_id")
    groups = checkpointed(groups)
    least = checkpointed(groups.join(ids, "row").groupBy("component").agg(F.min("doc_id").alias("least")))
    named = groups.join(least, "component").select("row", "least", F.lit(True).alias("grouped"))
    return (
        ids.join(info, "row").join(named, "row", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grouped"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def first_of_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of df that come first in their component, by doc_id (null last) and then by an arbitrary order; near copies and
    repeats of them go, rows without words stay."""
    docs = texts(df, key, text)
    distinct = one_row_each(df, key)
    info, groups = related(docs)
    groups = checkpointed(groups)
    ids = docs.select("row", "doc_id")
    first = groups.join(ids, "row").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))["row"].alias("row"))
    # a row's fate: all of its group but the first go; a repeated row with words stays once
    gone = groups.select("row").join(first.select("row"), "row", "left_anti").select("row", F.lit("gone").alias("fate"))
    again = ids.groupBy("row").count().where("count > 1").join(info.where("n > 0"), "row").join(gone, "row", "left_anti").select("row", F.lit("again").alias("fate"))
    fates = checkpointed(gone if distinct else gone.unionByName(again))
    columns = {c: f"c{i}" for i, c in enumerate(df.columns)}
    row = df[key].cast("long") if distinct else F.xxhash64(df[key].cast("long"), F.coalesce(df[text], F.lit("")))
    numbered = df.select(row.alias("row"), *[df[c].alias(x) for c, x in columns.items()]).join(fates, "row", "left")
    kept = numbered.where("fate is null")
    if not distinct and not fates.where("fate = 'again'").isEmpty():
        kept = kept.unionByName(numbered.where("fate = 'again'").dropDuplicates(["row"]))
    return kept.select(*[F.col(x).alias(c) for c, x in columns.items()])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), "doc_id", "text")


#: All pairs that share a shingle: for small tables, where no shingle is in very many documents.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS p FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(p[i : i + least(len(p), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, p, unnest(range(1, len(p) - least(len(p), 5) + 2)) AS i FROM w WHERE len(p) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reached(id, other) AS (
  SELECT a, b FROM links UNION SELECT id, b FROM reached JOIN links ON other = a
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS low FROM reached GROUP BY id) USING (doc_id)
"""
