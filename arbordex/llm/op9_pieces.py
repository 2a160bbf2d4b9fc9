"""Operator 9, SentencePiece encoding and decoding with sampled segmentations.

A word, with the spaces before it, is a lattice of the vocabulary's pieces. Forward filtering sums, for each place, the weight of
all ways to reach it; backward sampling then draws pieces from the end, each in proportion to the ways through it, so a
segmentation comes with the probability exp(SHARPNESS * sum of its pieces' log-probabilities), normalised. The vocabulary ranks
its pieces; log-probabilities are those of a Zipf law over these ranks. Draws depend on the row's key, the word's place in the
row and the place in the word alone, so a row gives the same pieces in any batch, partition or run.

Pieces may hold spaces only at their beginning, so none reaches over the end of a word and words are independent; a vocabulary with
others is refused. The longest piece bounds a step's ways. Words of more than STRIP characters are filtered and sampled in strips
with the same sums, whole and with a bounded lattice.

Characters without a piece of their own are written as byte pieces, and so is the character that stands for a space, so decoding
gives back every text. Null or empty text: no pieces, decoded as empty. A null key draws like key 0. Rows that repeat a key and a
text repeat its pieces. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from arbordex.llm.columns import buffers, mix, passes, ranges
from arbordex.llm.tables import forgets, mapped, table

MODEL = "piece_bpe_32k.model"
SPACE = "\u2581"
_TRUE = "\udc81"
SHARPNESS = 1.0
SEED = 20240229
#: Characters that one lattice spans at most; the strips of longer words are of this size.
STRIP = 2048
#: Words of up to so many characters are filtered together.
_WIDTHS = (4, 8, 12, 16, 24, 48)
#: The log-probability of a character without a piece.
_FALLBACK = -12.0
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(" *[^ ]+| +")


class Vocabulary:
    """Pieces by the hash of their characters, their weights, and the bytes that each id decodes to."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        usable, rank = [], 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank += 1
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece that reaches over the end of a word: {piece!r}")
                usable.append((piece, i, rank))
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(len(p) for p, _, _ in usable)
        hashes = np.array([self._hash(p) for p, _, _ in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        #: Whether any piece's hash begins with these 22 bits; most strings fail here, before the search.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).view(np.int64)] = True
        self.ids = np.array([i for _, i, _ in usable])[order]
        self.weights = -np.log(np.array([r for _, _, r in usable], np.float32)[order] + 1)

    @staticmethod
    def _hash(piece: str) -> int:
        value = np.zeros(1, np.uint64)
        for c in piece:
            value = value * _ROLL + np.uint64(ord(c) + 1)
        return int(mix(value)[0])

    def find(self, rolled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is such a piece, its place in ids and weights) of rolled character hashes."""
        hashed = mix(rolled)
        found = self.maybe[(hashed >> np.uint64(42)).view(np.int64)]
        some = np.flatnonzero(found)
        at = np.zeros(hashed.shape, np.int64)
        asked = hashed.ravel()[some]
        place = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        at.ravel()[some] = place
        found.ravel()[some] = self.hashes[place] == asked
        return found, at


@forgets
@lru_cache(maxsize=2)
def vocabulary(name: str = MODEL) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(name))


def _steps(points: np.ndarray, known: Vocabulary, sharpness: float, longest: int):
    """For each piece length from 1: (weight, piece) of the pieces that begin at each place of rows of code points."""
    width = points.shape[1]
    rolled = np.zeros(points.shape, np.uint64)
    for length in range(1, min(longest, width) + 1):
        rolled = rolled[:, : width - length + 1] * _ROLL + points[:, length - 1 :] + np.uint64(1)
        found, at = known.find(rolled)
        w = np.where(found, known.weights[at] * np.float32(sharpness), np.float32(-np.inf))
        p = np.where(found, known.ids[at], 0)
        if length == 1:
            w = np.where(found, w, np.float32(sharpness * _FALLBACK))
            p = np.where(found, p, -1 - points.astype(np.int64))
        yield w, p


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattices:
    """For each word and each end place in it: the cumulative probability of the last piece's length, and the pieces."""

    def __init__(self, words: list[str], known: Vocabulary, sharpness: float):
        self.length = np.array([len(w) for w in words])
        self.first = np.cumsum(self.length) - self.length
        total = int(self.length.sum())
        self.chance = np.ones((total, known.longest), np.float32)
        self.piece = np.zeros((total, known.longest), np.int32)
        low = 0
        for width in (*_WIDTHS, *sorted({n for n in self.length.tolist() if n > _WIDTHS[-1]})):
            some = np.flatnonzero((self.length > low) & (self.length <= width))
            low = width
            if len(some):
                self._fill(some, [words[i] for i in some.tolist()], width, known, sharpness)

    def _fill(self, some: np.ndarray, words: list[str], width: int, known: Vocabulary, sharpness: float) -> None:
        n, longest = len(words), min(known.longest, width)
        points = _points("".join(w.ljust(width, "\0") for w in words)).reshape(n, width)
        ways = np.full((n, width + 1), -np.inf, np.float32)
        ways[:, 0] = 0
        weight = np.full((width + 1, longest, n), -np.inf, np.float32)
        piece = np.zeros((width + 1, longest, n), np.int32)
        for k, (w, p) in enumerate(_steps(points, known, sharpness, longest)):
            for end in range(k + 1, width + 1):
                weight[end, k], piece[end, k] = w[:, end - k - 1], p[:, end - k - 1]
        rows = self.first[some]
        for end in range(1, width + 1):
            k = min(longest, end)
            each = weight[end, :k] + ways[:, end - k : end][:, ::-1].T
            top = each.max(axis=0)
            odds = np.exp(each - top)
            summed = np.cumsum(odds, axis=0)
            ways[:, end] = top + np.log(summed[-1])
            here = self.length[some] >= end
            at = rows[here] + end - 1
            self.chance[at, :k] = (summed / summed[-1]).T[here]
            self.piece[at, :k] = piece[end, :k].T[here]


def _strip(points: np.ndarray, begin: int, end: int, known: Vocabulary, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight, piece) of each length for each end place in (begin, end] of a long word."""
    first = max(0, begin - known.longest + 1)
    weight = np.full((end - begin, known.longest), -np.inf)
    piece = np.zeros((end - begin, known.longest), np.int64)
    for k, (w, p) in enumerate(_steps(points[None, first:end], known, sharpness, known.longest)):
        last = np.arange(first + k + 1, end + 1)  # where the pieces of this length end
        inside = last > begin
        weight[last[inside] - begin - 1, k], piece[last[inside] - begin - 1, k] = w[0, inside], p[0, inside]
    return weight, piece


def sampled_long(word: str, seed: np.uint64, known: Vocabulary, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """(start, id) of the pieces of a word of more than STRIP characters: one pass of sums forwards, one of draws backwards."""
    points, n = _points(word), len(word)
    ways = np.zeros(n + 1)
    for begin in range(0, n, STRIP):
        weight, _ = _strip(points, begin, min(begin + STRIP, n), known, sharpness)
        for i, w in enumerate(weight, begin + 1):
            k = min(known.longest, i)
            each = w[:k] + ways[i - k : i][::-1]
            top = each.max()
            ways[i] = top + np.log(np.exp(each - top).sum())
    starts, ids, at = [], [], n
    draws = (mix(seed + np.arange(n + 1).astype(np.uint64)) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    for begin in reversed(range(0, n, STRIP)):
        weight, piece = _strip(points, begin, min(begin + STRIP, n), known, sharpness)
        while at > begin:
            k = min(known.longest, at)
            odds = np.cumsum(np.exp(weight[at - begin - 1, :k] + ways[at - k : at][::-1] - ways[at]))
            length = min(int((odds / odds[-1] <= draws[at]).sum()), k - 1)
            ids.append(piece[at - begin - 1, length])
            at -= length + 1
            starts.append(at)
    return np.array(starts), np.array(ids)


def words_of(text: str) -> list[str]:
    """The text's words with the spaces before them, of which the first gets one more; a true space sign becomes a lone surrogate,
    which no text has."""
    return [w.replace(" ", SPACE) for w in _WORD.findall(" " + text.replace(SPACE, _TRUE))] if text else []


def encode(keys: np.ndarray, texts: list[str], known: Vocabulary, sharpness: float = SHARPNESS) -> list[np.ndarray]:
    """The sampled piece ids of each text."""
    index: dict[str, int] = {}
    words, counts = [], []
    for t in texts:
        own = words_of(t)
        words += [index.setdefault(w, len(index)) for w in own]
        counts.append(len(own))
    if not words:
        return [np.zeros(0, np.int64)] * len(texts)
    every = list(index)
    long = np.array([len(w) > STRIP for w in every])
    word, n = np.array(words), np.array(counts)
    row = np.repeat(np.arange(len(texts)), n)
    seed = mix(mix(keys.view(np.uint64) + np.uint64(SEED))[row] + ranges(n).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    lattice = Lattices(["" if x else w for w, x in zip(every, long.tolist())], known, sharpness)
    found = []
    for i in np.flatnonzero(long[word]).tolist():
        starts, ids = sampled_long(every[word[i]], seed[i], known, sharpness)
        found.append((np.full(len(ids), i), starts, ids))
    at, alive = lattice.length[word].copy(), np.flatnonzero(~long[word])
    while len(alive):
        node = lattice.first[word[alive]] + at[alive] - 1
        draw = (mix(seed[alive] + at[alive].astype(np.uint64)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
        length = np.minimum((lattice.chance[node] <= draw[:, None]).sum(axis=1), np.minimum(at[alive], known.longest) - 1)
        at[alive] -= length + 1
        found.append((alive, at[alive], lattice.piece[node, length].astype(np.int64)))
        alive = alive[at[alive] > 0]
    which, start, ids = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((start, which))
    which, ids = which[order], ids[order]
    if (ids < 0).any():
        parts = []
        for i in np.flatnonzero(ids < 0).tolist():
            c = chr(-1 - int(ids[i]))
            parts.append(known.byte_id[list((SPACE if c == _TRUE else c).encode("utf-8", "surrogatepass"))])
        size = np.ones(len(ids), np.int64)
        size[ids < 0] = [len(p) for p in parts]
        wide = np.repeat(ids, size)
        wide[wide < 0] = np.concatenate(parts)
        which, ids = np.repeat(which, size), wide
    cuts = np.searchsorted(row[which], np.arange(len(texts) + 1))
    return [ids[a:b] for a, b in zip(cuts.tolist(), cuts.tolist()[1:])]


def decode(ids: list[int], known: Vocabulary) -> bytes:
    """The text's bytes; the space that encoding puts in front goes."""
    return b"".join(map(known.bytes.__getitem__, ids))[1:]


def _texts(column: pa.Array, size: int = 1 << 19):
    """(first row, end row, texts) of passes over a text column."""
    data, offsets = buffers(column)
    for first, end, part, at in passes(data, offsets, size):
        raw, at = part.tobytes(), at.tolist()
        yield first, end, [raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(at, at[1:])]


def encoded(df: DataFrame, key: str, text: str, sharpness: float = SHARPNESS) -> DataFrame:
    """(key, pieces array<int>) of each row."""

    def run(batches):
        known = vocabulary()
        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for first, end, texts in _texts(b.column(1)):
                pieces = encode(keys[first:end], texts, known, sharpness)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(pieces, pa.list_(pa.int32()))], [key, "pieces"])

    return mapped(df.select(df[key].cast("long").alias(key), df[text].alias("_text")), run, f"`{key}` long, pieces array<int>")


def decoded(df: DataFrame, key: str, pieces: str = "pieces") -> DataFrame:
    """(key, text) of each row of piece ids; null pieces are an empty text."""

    def run(batches):
        known = vocabulary()
        for b in batches:
            texts = [decode(x or [], known) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], [key, "text"])

    return mapped(df.select(df[key].cast("long").alias(key), df[pieces].alias("_pieces")), run, f"`{key}` long, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256) of every document: pieces sampled with its doc_id, then decoded again."""

    def run(batches):
        known = vocabulary()
        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for first, end, texts in _texts(b.column(1)):
                rows = []
                for ids in encode(keys[first:end], texts, known):
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(decode(ids.tolist(), known)).hexdigest()))
                n, crc, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents")
    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
