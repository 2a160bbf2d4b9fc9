"""Operator 4, best-fit packing of tokenised documents by linear grouping.

1. Tokenise, cut documents of more than CAPACITY tokens (the first piece takes the remainder), keep the pieces in the shared
   folder and count their lengths: at most CAPACITY numbers, all that the driver ever sees.
2. Plan on those counts. Lengths above SMALL are sorted and put into at most GROUPS groups of equal cardinality, each rounded
   up to its largest length. The linear programme over configurations of these few sizes is solved by column generation (a
   knapsack prices new configurations), and its whole parts are used. Actual lengths replace the rounded ones. What is left
   over and the small lengths go, longest first, to the fullest sequence that still has room.
3. The plan says which ranks among the pieces of one length go where. Ranks are numbered within (length, salt) groups, so no
   length that many documents share lands in one task. Pieces of CAPACITY tokens fill a sequence each and need no rank.

Null text is an empty text: one piece with the end token alone. Repeated rows, and rows that share a doc_id or have none, are packed
as often as they occur. `rounds` and `patience` bound the planner's search for fewer sequences, never what is packed.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbordex.llm.tables import checkpointed, forgets, mapped, partitions, table

CAPACITY = 1024
END = 2
SMALL = CAPACITY // 3
GROUPS = 240
#: Bytes of words and ids that a task remembers; it forgets them, and the tokenizer, when it ends.
CACHE_BYTES = 48 << 20
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPECIAL = "<|endoftext|>"


class WordIds(dict):
    """Ids, as little-endian bytes, of a word without spaces, after `prefix`; asked words are remembered.

    A full stop or comma after letters, and a line end between two words, are tokens of their own, so that such words are
    put together from simpler ones.
    """

    def __init__(self, encode, prefix: str, bare: WordIds | None = None):
        self.encode, self.prefix, self.bare, self.size = encode, prefix, bare, 0
        self.marks = {c: encode(c) for c in ".,\n"}

    def __missing__(self, word: str) -> bytes:
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            out = self[word[:-1]] + self.marks[word[-1]]
        elif (at := word.find("\n")) > 0 and not word[at - 1].isspace() and at + 1 < len(word) and not word[at + 1].isspace():
            out = self[word[:at]] + self.marks["\n"] + (self if self.bare is None else self.bare)[word[at + 1 :]]
        else:
            out = self.encode(self.prefix + word)
        self[word] = out
        self.size += len(word) + len(out) + 150  # and two objects with their place in the table
        return out


@forgets
@lru_cache(maxsize=4)
def whole(name: str) -> Tokenizer:
    """The tokenizer file itself, for texts with the name of a special token."""
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@forgets
@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY):
    """text -> little-endian 32-bit ids, the same as the tokenizer file's.

    Splitting at single spaces never cuts a token, but where white space surrounds one; such texts, and texts with the
    name of a special token, are encoded whole.
    """
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ordinary(text: str) -> bytes:
        return array("I", encoding.encode_ordinary(text)).tobytes()

    bare = WordIds(ordinary, "")
    spaced = WordIds(ordinary, " ", bare)
    get = spaced.__getitem__

    def encode(text: str) -> bytes:
        if _SPECIAL in text:
            return array("I", whole(name).encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        # a space between two white spaces, or one after white space at the end, may belong to a longer token
        if ("" in rest or _edges(rest)) and any((not b or b[0].isspace()) and (not a or a[-1].isspace()) for a, b in zip([first, *rest], rest)):
            return ordinary(text)
        return (bare[first] if first else b"") + b"".join(map(get, rest))

    return encode


def _edges(parts: list[str]) -> bool:
    return any(map(str.isspace, [p[0] for p in parts]))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, key: str, text: str, name: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of each row."""

    def run(batches):
        encode, end = encoder(name), array("I", [END]).tobytes()
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(t or "") + end
                rows += [(k, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return mapped(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")), run, PIECES)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """The lengths, longest first, as at most `groups` lists of (length, count) of equal cardinality."""
    total = sum(counts.values())
    size, out, room = -(-total // groups), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps, without a linear algebra library's threads."""
    k = len(matrix)
    both = np.hstack([matrix, np.eye(k)])
    for i in range(k):
        p = i + int(np.abs(both[i:, i]).argmax())
        if p != i:
            both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        used = np.flatnonzero(factor)
        both[used] -= factor[used, None] * both[i]
    return both[:, k:]


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 3000, patience: int = 100) -> list[tuple[np.ndarray, float]]:
    """The basis of the linear programme that covers `demand` with as few configurations as it can: (slots of each size, times).

    Demands are set apart by small fractions while it runs, so that ties don't stall it; it ends when no configuration
    would help, or when `patience` exchanges gained nothing to speak of.
    """
    apart = demand * (1 + 1e-4 * np.arange(len(demand)) / len(demand))
    best_total, idle = np.inf, 0
    k = len(sizes)
    size = np.array(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse, most = _inverse(basis), capacity // min(sizes)
    room = np.arange(capacity + 1)
    from_ = room[:, None] - size[None, :]
    allowed = from_ >= 0
    from_ = np.maximum(from_, 0)
    for i in range(rounds):
        price = inverse.sum(axis=0)
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            value = np.where(allowed & (price > 1e-12), best[from_] + price, -1.0)
            pick = value.argmax(axis=1)
            gain = value[room, pick]
            pick = np.where(gain > best + 1e-12, pick, -1)
            picks.append(pick)
            best = np.maximum(best, gain)
        if best[capacity] < 1 + 1e-6:
            break
        column, at = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[at] >= 0:
                column[pick[at]] += 1
                at -= size[pick[at]]
        step, x = (inverse * column).sum(axis=1), (inverse * apart).sum(axis=1)
        idle = 0 if x.sum() < best_total * (1 - 1e-5) else idle + 1
        best_total = min(best_total, x.sum())
        if idle > patience:
            break
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if i % 50 == 49:
            inverse = _inverse(basis)
        else:
            inverse[out] /= step[out]
            others = np.arange(k) != out
            inverse[others] -= step[others, None] * inverse[out]
    return [(np.rint(basis[:, j]).astype(int), float(x)) for j, x in enumerate((_inverse(basis) * demand).sum(axis=1))]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for all counted lengths; its work depends on capacity alone."""
    left = {length: n for length, n in counts.items() if n}
    done = [((capacity,), left.pop(capacity))] if capacity in left else []
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]

    def put(lengths: tuple[int, ...], n: int) -> None:
        if n:
            open_[capacity - sum(lengths)].append((lengths, n))

    large = {length: n for length, n in left.items() if length > small}
    if large:
        grouped = linear_groups(large, groups)
        stock = [list(g) for g in grouped]
        have = [sum(n for _, n in g) for g in grouped]
        for slots, times in configurations([g[0][0] for g in grouped], np.array(have, float), capacity):
            kinds = [g for g, n in enumerate(slots) for _ in range(n)]
            times = min([int(times + 1e-6), *(have[g] // n for g, n in enumerate(slots) if n)])
            if times <= 0 or not kinds:
                continue
            runs = []
            for g in kinds:
                need, taken = times, []
                while need:
                    length, n = stock[g][0]
                    use = min(n, need)
                    taken.append((length, use))
                    need -= use
                    stock[g][0] = (length, n - use)
                    if n == use:
                        stock[g].pop(0)
                have[g] -= times
                runs.append(taken)
            cuts = sorted({c for r in runs for c in np.cumsum([n for _, n in r]).tolist()})
            places, used = [0] * len(runs), [0] * len(runs)
            before = 0
            for c in cuts:
                lengths = tuple(r[p][0] for r, p in zip(runs, places))
                put(lengths, c - before)
                for i, r in enumerate(runs):
                    used[i] += c - before
                    if used[i] == r[places[i]][1]:
                        places[i], used[i] = places[i] + 1, 0
                before = c
        rest: dict[int, int] = {}
        for g in stock:
            for length, n in g:
                rest[length] = rest.get(length, 0) + n
    else:
        rest = {}
    for length, n in left.items():
        if length <= small:
            rest[length] = n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = next((r for r in range(length, capacity) if open_[r]), None)
            if room is None:
                each = capacity // length
                whole, last = divmod(n, each)
                put((length,) * each, whole)
                put((length,) * last, 1 if last else 0)
                break
            lengths, have_n = open_[room].pop()
            fit = min(room // length, max(1, n // have_n))
            use = min(have_n, n // fit)
            put(lengths + (length,) * fit, use)
            put(lengths, have_n - use)
            n -= use * fit
    return done + [x for bucket in open_ for x in bucket]


def assignment(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For runs of ranks within a length: where each begins, the sequence of its first rank, and the place in the sequence."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            at = rank.get(length, 0)
            rows.append((length << 44 | at, sequence, offset))
            rank[length] = at + n
            offset += length
        sequence += n
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 3)
    return {"run": table_[:, 0].copy(), "sequence": table_[:, 1].copy(), "offset": table_[:, 2].copy()}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PIECES with sequence_id and offset added; `made` must give the same rows whenever it is read."""
    spark = made.sparkSession
    counts = {r[0]: r[1] for r in made.groupBy("length").count().collect()}
    full = made.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    counts.pop(capacity, None)
    shared = spark.sparkContext.broadcast(assignment(plan(counts, capacity)))
    rest = made.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(partitions(spark))))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    sizes = rest.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    numbered = ranked.join(before, ["length", "salt"]).select(*[c.split()[0] for c in PIECES.split(", ")], (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches):
        where = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(where["run"], length << 44 | rank, side="right") - 1
            first = where["run"][at] & ((1 << 44) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(where["sequence"][at] + rank - first), pa.array(where["offset"][at])], names)

    names = [c.split()[0] for c in PIECES.split(", ")] + ["sequence_id", "offset"]
    return mapped(numbered, run, f"{PIECES}, sequence_id long, offset long").unionByName(full)


def packed_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    return pack(checkpointed(pieces(df, key, text)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
