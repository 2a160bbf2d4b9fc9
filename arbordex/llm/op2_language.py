"""Operator 2, language ID: multinomial naive Bayes over hashed character n-grams.

Fit: at most SAMPLE_PER_LANGUAGE different labelled texts of each language (chosen by a hash of id and text; all of a rare language)
are counted into BINS buckets of 1- to 3-grams. The log-probability matrix, BINS x languages, is broadcast, BLOCK languages at a time, so
a broadcast has 64 MB at most. More languages are scored block by block: a row carries the best language so far and the sum of all
odds against it, and the result is that of one matrix. Scoring is a sparse gather and a sum for each text, in numpy, at most GATHERED
numbers at a time however long a text is.

N-grams run over the code points of the lower-cased text with a space before and after; digits and marks count as they are.
Null text, empty text or text without a letter: `und` with score 0. No labelled text at all: `und` with score 0 for every
row. Ties between languages: the first by name. Repeated rows score alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.columns import buffers, mix, passes
from arbordex.llm.tables import checkpointed, mapped, sampled, table

BINS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 3000
BLOCK = 256
SMOOTHING = 0.5
UNKNOWN = "und"
#: Log-probabilities that scoring gathers at once.
GATHERED = 1 << 21


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, end of each text in that list); a text of n code points has about 3n."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in padded])
    out = np.zeros((len(points), len(ORDERS)), np.int64)
    rolled, inside = np.zeros(len(points), np.uint64), np.repeat(ends, [len(p) for p in padded]) - np.arange(len(points))
    for k, order in enumerate(ORDERS):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - order + 1] = points[order - 1 :]
        rolled = rolled * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        bucket = (mix(rolled + np.uint64(order << 58)) >> np.uint64(48)).astype(np.int64) & (BINS - 1)
        out[:, k] = np.where(inside >= order, bucket, BINS)  # the bucket past the last weighs nothing
    return out.ravel(), ends * len(ORDERS)


def fit(labelled: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray | Blocks]:
    """(languages, log-probability matrix) from the rows of `labelled` that have a text and a label."""
    rows = labelled.select(labelled[key].alias("key"), labelled[text].alias("text"), labelled[label].alias("label")).where("text is not null and label is not null")
    sample = sampled(rows, "key", "text", per_language, "label")
    names = sorted(r[0] for r in sample.select("label").distinct().collect())
    if not names:
        return [], np.zeros((BINS + 1, 0), np.float32)
    number = {n: i for i, n in enumerate(names)}

    def count(batches):
        for b in batches:
            texts, labels = b.column(0).to_pylist(), np.array([number[x] for x in b.column(1).to_pylist()])
            for first in range(0, len(texts), 200):
                bins, ends = grams(texts[first : first + 200])
                which = np.repeat(labels[first : first + 200], np.diff(ends, prepend=0))
                found, n = np.unique((which * (BINS + 1) + bins)[bins < BINS], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found // (BINS + 1)).astype(np.int32)), pa.array((found % (BINS + 1)).astype(np.int32)), pa.array(n)], ["label", "bin", "n"])

    # the sample is bounded, so a few tasks count it, however many files it came from
    counted = mapped(sample.select("text", "label").repartition(12), count, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    if len(names) <= BLOCK:
        return names, _matrix(counted, 0, len(names))
    return names, Blocks(checkpointed(counted), len(names))


def _matrix(counted: DataFrame, first: int, languages: int) -> np.ndarray:
    """Log-probabilities, (BINS + 1) x languages, from (label, bin, n)."""
    found = counted.where(F.col("label").between(first, first + languages - 1)).toArrow()
    matrix = np.full((BINS + 1, languages), SMOOTHING)
    np.add.at(matrix, (found["bin"].to_numpy(), found["label"].to_numpy() - first), found["n"].to_numpy())
    matrix = np.log(matrix) - np.log(matrix[:BINS].sum(axis=0))
    matrix[BINS] = 0
    return matrix.astype(np.float32)


class Blocks:
    """The matrix of more than BLOCK languages, of which the driver makes one block at a time."""

    def __init__(self, counted: DataFrame, languages: int):
        self.counted, self.languages = counted, languages

    def block(self, first: int, size: int) -> np.ndarray:
        return _matrix(self.counted, first, min(size, self.languages - first))


def summed(weights: np.ndarray, bins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the bins' rows of `weights` for each text. Several texts are one gather; a text of many bins is several."""
    step = max(1024, GATHERED // max(weights.shape[1], 1))
    if len(ends) == 1 and len(bins) > step:
        return sum(weights[bins[first : first + step]].sum(axis=0, dtype=np.float64, keepdims=True) for first in range(0, len(bins), step))
    return np.add.reduceat(weights[bins], np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)


def predict(df: DataFrame, key: str, text: str, model: tuple[list[str], np.ndarray | Blocks], keep: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """(key, each column of `keep`, lang_pred, score) for each row; score is the posterior of the language chosen."""
    names, matrix = model
    keep = {key: df[key], **(keep or {})}
    own = [f"c{i}" for i in range(len(keep))]
    state = df.select(df[text].alias("_text"), *[c.alias(n) for n, c in zip(own, keep.values())], F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("odds"))
    for first in range(0, len(names), block):
        part = matrix.block(first, block) if isinstance(matrix, Blocks) else matrix[:, first : first + block]
        state = _scored(checkpointed(state) if first else state, names[first : first + block], part)
    known = F.col("lang_pred") != UNKNOWN
    return state.select(*[F.col(n).alias(c) for n, c in zip(own, keep)], "lang_pred", F.when(known, 1 / F.col("odds")).otherwise(F.lit(0.0)).alias("score"))


def _scored(state: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """`state` after some more languages: the best so far, its log-probability, and the sum of all odds against it."""
    shared = state.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix))
    columns, size = state.columns, len(state.columns)

    def run(batches):
        weights = shared.value
        for b in batches:
            data, offsets = buffers(b.column(0))
            before = [b.column(i).to_pylist() for i in range(size - 3, size)]
            langs, tops, every, row = [], [], [], 0
            for _, _, part, at in passes(data, offsets, max(4096, GATHERED // (len(ORDERS) * len(names)))):
                raw = part.tobytes()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(at.tolist(), at.tolist()[1:])]
                sums = summed(weights, *grams(texts))
                odds = np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1).tolist()
                for t, i, m, s in zip(texts, sums.argmax(axis=1).tolist(), sums.max(axis=1).tolist(), odds):
                    lang, top, old = (c[row] for c in before)
                    row += 1
                    if any(map(str.isalpha, t)):
                        high = max(top, m)
                        old = s * math.exp(m - high) + (old * math.exp(top - high) if old else 0.0)
                        lang, top = (names[i] if m > top else lang), high
                    langs.append(lang)
                    tops.append(top)
                    every.append(old)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(size - 3)), pa.array(langs, pa.string()), pa.array(tops, pa.float64()), pa.array(every, pa.float64())], columns)

    return mapped(state, run, state.schema)


def held_out(key: Column) -> Column:
    """Whether a key belongs to the quarter that fitting never sees."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs["doc_id"])), "doc_id", "text", "lang")
    return predict(docs, "doc_id", "text", model, {"held_out": held_out(docs["doc_id"])})


def reject_unknown(df: DataFrame, key: str, text: str, label: str, least: float = 0.5) -> DataFrame:
    """The rows of df whose language is known with a posterior of at least `least`; a null label becomes the prediction."""
    model = fit(df, key, text, label)
    own = [c for c in df.columns if c != text]
    found = predict(df, key, text, model, {**{f"own_{i}": df[c] for i, c in enumerate(own)}, "own_text": df[text]})
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    columns = {c: F.col(f"own_{i}") for i, c in enumerate(own)} | {text: F.col("own_text")}
    columns[label] = F.coalesce(columns[label], F.col("lang_pred"))
    return kept.select(*[columns[c].alias(c) for c in df.columns])
