"""Operator 7, secret scans: character Markov models of random strings and of ordinary identifiers.

Three base patterns give their spans. The models judge each token of MIN_TOKEN or more characters by itself, inside and outside of
base spans: two first-order character models with word ends, and the log-likelihood ratio of `random` to `ordinary` over the whole
token. A token at or above THRESHOLD nats is a span of kind `markov`, so a labelled secret has a base span and, if it looks random,
a `markov` span; a secret without a label or of another length has the latter alone.

The models are trained here from labelled samples: random strings from a seeded generator, and ordinary tokens of a bounded sample
of texts (SAMPLE_TEXTS texts, SAMPLE_WORDS tokens of each; base spans cut out) with identifiers built of them. One in HELD_OUT of
either kind is never trained on; `evaluate` gives precision and recall on these.

Null or empty text: no spans. Spans count code points, end exclusive, ordered by start, then by kind as in KINDS. Rows that repeat or
share a key give a row each; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm.tables import mapped, sampled, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: A quick test that every match of ASSIGN passes.
ASSIGN_HINT = re.compile(r"[=:]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_TOKEN = 10
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
SAMPLE_TEXTS = 2000
PASS_BYTES = 1 << 19
SAMPLE_WORDS = 200
HELD_OUT = 5
#: Nats in favour of `random` that a token needs: about one random token in 60,000 is expected beforehand.
THRESHOLD = 11.0
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(_ALPHABET), np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = range(len(_ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each match of the three base patterns."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(out)


def codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all tokens with a mark between them, place of the mark before each token)."""
    place = np.cumsum([0, *(len(t) + 1 for t in tokens)])
    return _CODE[np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("latin-1", "replace"), np.uint8)], place[:-1]


def transitions(samples: list[str]) -> np.ndarray:
    """Smoothed log-probabilities of one character after another; row and column past the alphabet stand for a token's ends."""
    n = len(_ALPHABET) + 1
    counts = np.full((n, n), 0.5)
    c, _ = codes(samples)
    np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def scores(tokens: list[str], ratios: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each token, from its beginning to its end."""
    c, place = codes(tokens)
    return np.add.reduceat(ratios[c[:-1], c[1:]], place) if tokens else np.zeros(0)


def random_strings(n: int = 10_000, seed: int = 7) -> list[str]:
    """Labelled random: base64, hexadecimal, alphanumeric and upper-case strings of MIN_TOKEN to 64 characters."""
    rng, out = np.random.default_rng(seed), []
    sets = (_ALPHABET[:64], "0123456789abcdef", _ALPHABET[:62], _ALPHABET[:26] + "0123456789")
    for i in range(n):
        chars = sets[i % len(sets)]
        out.append("".join(chars[k] for k in rng.integers(0, len(chars), int(rng.integers(MIN_TOKEN, 65)))))
    return out


def ordinary_strings(words: list[str], n: int = 20_000, seed: int = 11) -> list[str]:
    """Labelled ordinary: the tokens themselves, snake, kebab, camel, path and numbered identifiers of two to four of their words,
    dates, versions and phone numbers."""
    letters = [w for w in words if w.isalpha() and len(w) <= 24] or "value index first second reader writer config default option number".split()
    rng, out = np.random.default_rng(seed), list(words)
    for i in range(n):
        some = [letters[k] for k in rng.integers(0, len(letters), int(rng.integers(2, 5)))]
        a, b, c = rng.integers(0, 10_000, 3).tolist()
        shapes = ("_".join(some), "-".join(some), "".join(w.title() for w in some), "/".join(some), "_".join(some).upper(), f"{''.join(some)}{a % 100}", some[0] + "".join(w.title() for w in some[1:]), f"{1900 + a % 200}-{b % 12 + 1:02}-{c % 28 + 1:02}", f"{a:04}-{b:04}-{c:04}", f"{a % 1000:03}-{b:04}", f"{some[0]}-{a % 20}-{b % 100}", some[0] * 2)
        out.append(shapes[i % len(shapes)])
    return out


def _split(samples: list[str], held_out: bool) -> list[str]:
    """The samples of one side: a string is on the same side wherever it comes from."""
    return [s for s in samples if (zlib.crc32(s.encode()) % HELD_OUT == 0) == held_out]


def train(words: list[str]) -> np.ndarray:
    """Log-likelihood ratios of the transitions: above 0 where random strings have them more often."""
    return transitions(_split(random_strings(), False)) - transitions(_split(ordinary_strings(words), False))


def evaluate(words: list[str], ratios: np.ndarray) -> dict[str, float]:
    """Recall and precision over the held-out samples, and the share of the held-out ordinary ones that is taken for random."""
    random, ordinary = ([t for t in _split(x, True) if len(t) >= MIN_TOKEN] for x in (random_strings(), ordinary_strings(words)))
    hits, alarms = (int((scores(x, ratios) >= THRESHOLD).sum()) for x in (random, ordinary))
    return {"recall": hits / max(len(random), 1), "precision": hits / max(hits + alarms, 1), "false_alarms": alarms / max(len(ordinary), 1)}


def sample_words(df: DataFrame, key: str, text: str, texts: int = SAMPLE_TEXTS) -> list[str]:
    """Tokens of two or more characters of at most `texts` different texts, chosen by a hash of key and text, up to SAMPLE_WORDS of
    each; base spans are cut out."""
    chosen = sampled(df, key, text, texts).select("text")

    def words(batches):
        for b in batches:
            out = set()
            for t in b.column(0).to_pylist():
                t, at, parts = t or "", 0, []
                for start, _, end in base_spans(t):
                    parts.append(t[at:start])
                    at = max(at, end)
                parts.append(t[at:])
                some = re.findall(r"[A-Za-z0-9+/_=-]{2,64}", " ".join(parts), re.A)
                out.update(some[:: max(1, len(some) // SAMPLE_WORDS)][:SAMPLE_WORDS])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["word"])

    # texts x SAMPLE_WORDS bounds what the driver gets; sorting makes it the same however the rows lie
    return sorted(r[0] for r in mapped(chosen, words, "word string").distinct().collect())


def spans(texts: list[str], ratios: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text: the base spans, and the tokens that look random."""
    tokens = [[(m.start(), m[0]) for m in TOKEN.finditer(t)] for t in texts]
    every = list({w for some in tokens for _, w in some})
    random = {w for w, x in zip(every, (scores(every, ratios) >= THRESHOLD).tolist()) if x}
    for t, some in zip(texts, tokens):
        yield sorted(base_spans(t) + [(at, 3, at + len(w)) for at, w in some if w in random])


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _passes(column: pa.Array) -> Iterator[list[str]]:
    """A column's texts, some hundred kilobytes at a time."""
    rows = max(1, len(column) * PASS_BYTES // max(column.nbytes, 1))
    for first in range(0, len(column), rows):
        yield [t or "" for t in column.slice(first, rows).to_pylist()]


def scan(df: DataFrame, key: str, text: str, ratios: np.ndarray) -> DataFrame:
    """(key, SCHEMA) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for b in batches:
            rows = []
            for some in _passes(b.column(1)):
                for found in spans(some, shared.value):
                    base = [x for x in found if x[1] < 3]
                    n = [sum(x[1] == k for x in base) for k in range(3)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["c0", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = mapped(df.select(df[key].alias("c0"), df[text].alias("c1")), run, f"c0 {dict(df.dtypes)[key]}, {SCHEMA}")
    return found.withColumnRenamed("c0", key)


def masked(text: str, found: list[tuple[int, int, int]], mask: str) -> str:
    """The text with its spans replaced; spans that touch or overlap by one mask."""
    at, last, parts = 0, -1, []
    for start, _, end in found:
        if start > last:
            parts += [text[at:start], mask]
        at = last = max(last, end)
    return "".join([*parts, text[at:]]) if parts else text


def redact(df: DataFrame, key: str, text: str, mask: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """df with every span of its texts replaced by `mask` (spans that touch or overlap by one), and `length` set to the new
    number of code points. Texts without spans stay as they are; null stays null."""
    ratios = df.sparkSession.sparkContext.broadcast(train(sample_words(df, key, text)))

    def run(batches):
        for b in batches:
            out = []
            for some in _passes(b.column(0)):
                out += [masked(t, found, mask) for t, found in zip(some, spans(some, ratios.value))]
            out = [None if null else t for t, null in zip(out, b.column(0).is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(b.column(i) for i in range(1, b.num_columns))], names)

    own = [c for c in df.columns if c != text]
    names = ["_text", *(f"c{i}" for i in range(len(own)))]
    source = df.select(df[text].alias("_text"), *[df[c].alias(f"c{i}") for i, c in enumerate(own)])
    found = mapped(source, run, source.schema)
    columns = {text: F.col("_text")} | {c: F.col(f"c{i}") for i, c in enumerate(own)}
    if length in columns:
        columns[length] = F.when(F.col("_text").isNull(), columns[length]).otherwise(F.char_length("_text")).cast(dict(df.dtypes)[length])
    return found.select(*[columns[c].alias(c) for c in df.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text", train(sample_words(docs, "doc_id", "text")))
