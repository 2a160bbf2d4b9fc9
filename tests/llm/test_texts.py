"""Operators on single texts: exact round trips, brute force, held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbordex.llm import mjpeg, op1_media, op2_language, op4_packing, op6_fingerprints, op7_secrets, op9_pieces


def utf8(t):
    return (t or "").encode()


def test_media_round_trip(docs, corpus, none):
    texts = {r[0]: utf8(r[1]) for r in corpus}
    got = op1_media.digests(docs, "doc_id", "text").collect()
    assert len(got) == len(corpus)
    same = {}
    for r in got:
        t = texts[r.doc_id]
        padded = t + b"\0" * ((-len(t)) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert same.setdefault(t, r[1:]) == r[1:]
    assert op1_media.digests(none, "doc_id", "text").count() == 0


def test_any_bytes_survive():
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * k, dtype=np.uint8).tobytes() for k in (1, 16, 17, 40)] + [b"\xff" * 64, b"\xff\0" * 64, b"\0" * 64]
    for p, (fps, frames) in zip(payloads, mjpeg.read_frames(mjpeg.write_payloads(payloads))):
        assert fps == mjpeg.FPS and b"".join(f.tobytes() for f in frames) == p


def baseline(grey, quant=1):
    """A flat-block baseline frame: each 8x8 block has one level."""
    rows, columns = grey.shape
    dht = lambda cls, bits, symbols: mjpeg._segment(0xC4, bytes([cls]) + bytes(bits) + bytes(symbols))
    head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0]) + bytes([8 * quant] + [1] * 63)) + mjpeg._segment(0xC0, bytes([8, rows >> 8, rows & 255, columns >> 8, columns & 255, 1, 1, 0x11, 0]))
    head += dht(0, [0, 0, 0, 9] + [0] * 12, range(9)) + dht(0x10, [1] + [0] * 15, [0]) + mjpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits, before = "", 0
    for y in range(0, rows, 8):
        for x in range(0, columns, 8):
            level = (int(grey[y, x]) - 128) // quant
            diff, before = level - before, level
            size = abs(diff).bit_length()
            bits += f"{size:04b}" + (format(diff if diff > 0 else diff + (1 << size) - 1, f"0{size}b") if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    return head + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def test_baseline_frames_and_shots(spark):
    dark, light = np.full((16, 24), 40, np.uint8), np.full((16, 24), 200, np.uint8)
    dark[8:, 8:16] = 90
    frames = [baseline(dark)] * 6 + [baseline(light)] * 5
    avi = mjpeg.write_avi(frames)
    [(fps, got)] = mjpeg.read_frames([avi])
    assert (got[0] == dark).all() and (got[-1] == light).all()
    unindexed = avi[: avi.rindex(b"idx1")]
    assert len(mjpeg.read_avi(unindexed).chunks) == 11
    df = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"nothing"))], "id long, media binary")
    rows = sorted(op1_media.clips(df, "id", "media").collect(), key=lambda r: (r.id, r.clip or 0))
    assert [(r.id, r.clip, r.first_frame, r.end_frame) for r in rows] == [(1, 0, 0, 6), (1, 1, 6, 11), (3, None, None, None)]
    assert rows[1].start_s == pytest.approx(6 / 25) and "AVI" in rows[2].error


def code_words(counts, symbols):
    out, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[symbols[at]] = format(code, f"0{n}b")
            code, at = code + 1, at + 1
        code *= 2
    return out


def magnitude(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def stuffed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def colour_frame(rng, columns, rows, restart):
    """A 4:2:0 frame without Huffman tables, and its luma by the textbook formula."""
    books = {}
    for k, (counts, first) in mjpeg.TYPICAL.items():
        symbols = list(bytes.fromhex(first))
        rest = [r << 4 | n for r in range(16) for n in range(1, 11)] if k >= 16 else []
        books[k] = code_words([int(x) for x in counts.split()], symbols + [x for x in rest if x not in symbols])
    quant, zigzag = rng.integers(1, 20, 64), sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    across, down = -(-columns // 16), -(-rows // 16)
    luma, parts, bits = np.zeros((down * 16, across * 16)), [], ""
    before = [0, 0, 0]
    for mcu in range(across * down):
        if mcu and mcu % restart == 0:
            parts.append(bits)
            bits, before = "", [0, 0, 0]
        for component, b in [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (2, 0)]:
            block = np.where(rng.random(64) < 0.15, rng.integers(-20, 21, 64), 0)
            block[0] = rng.integers(-40, 41)
            block[63] = rng.integers(-1, 2)
            dc, ac = books[int(component > 0)], books[16 + int(component > 0)]
            n, low = magnitude(int(block[0]) - before[component])
            bits, before[component], run = bits + dc[n] + low, int(block[0]), 0
            for v in block[1 : 1 + max([k for k in range(1, 64) if block[k]], default=0)].tolist():
                if not v:
                    run += 1
                    continue
                bits += ac[0xF0] * (run // 16)
                n, low = magnitude(v)
                bits, run = bits + ac[(run % 16) << 4 | n] + low, 0
            if not block[63]:
                bits += ac[0]
            if component == 0:
                y, x = (mcu // across) * 16 + b // 2 * 8, (mcu % across) * 16 + b % 2 * 8
                level = np.zeros(64)
                level[zigzag] = block * quant
                scale = [0.5**0.5] + [1] * 7
                for i in range(8):
                    for j in range(8):
                        luma[y + i, x + j] = sum(scale[u] * scale[v] * level[8 * u + v] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
    parts.append(bits)
    head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0, *quant.tolist()])) + mjpeg._segment(0xC0, bytes([8, rows >> 8, rows & 255, columns >> 8, columns & 255, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += mjpeg._segment(0xDD, bytes([0, restart])) + mjpeg._segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    body = b"".join(stuffed(p) + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    return head + body + b"\xff\xd9", np.clip(np.rint(luma[:rows, :columns] + 128), 0, 255)


def test_colour_frames_with_typical_tables():
    rng = np.random.default_rng(6)
    for columns, rows, restart in ((40, 24, 100), (33, 50, 2)):
        frame, luma = colour_frame(rng, columns, rows, restart)
        [got] = mjpeg.decode_frames([frame])
        assert got.shape == luma.shape and np.abs(got - luma).max() <= 1


def lossless_frame(samples, predictor):
    rows, columns = samples.shape
    counts, symbols = [0, 1, 2, 3, 1, 1, 1] + [0] * 9, [3, 2, 1, 4, 0, 5, 6, 7, 8]
    words, bits, s = code_words(counts, symbols), "", samples.astype(int)
    for y in range(rows):
        for x in range(columns):
            a, b, c = s[y, x - 1], s[y - 1, x], s[y - 1, x - 1]
            guess = (128 if not x else a) if not y else b if not x else [0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor]
            n, low = magnitude(int(s[y, x] - guess))
            bits += words[n] + low
    return b"\xff\xd8" + mjpeg._segment(0xC3, bytes([8, rows >> 8, rows & 255, 0, columns, 1, 1, 0x11, 0])) + mjpeg._segment(0xC4, bytes([0, *counts, *symbols])) + mjpeg._segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + stuffed(bits) + b"\xff\xd9"


def test_foreign_lossless_frames():
    rng = np.random.default_rng(7)
    for predictor in range(1, 8):
        samples = (np.cumsum(rng.integers(-3, 4, (9, 21)), axis=1) + 100).astype(np.uint8)
        [got] = mjpeg.decode_frames([lossless_frame(samples, predictor)])
        assert (got == samples).all()


def riff(kind, body):
    return kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def test_open_dml_files():
    grey = [np.full((8, 8), 8 * k, np.uint8) for k in range(1, 7)]
    frames = [baseline(g) for g in grey]
    strh = b"vidsMJPG" + bytes(12) + (2).to_bytes(4, "little") + (60).to_bytes(4, "little") + bytes(24)
    sound = riff(b"LIST", b"strl" + riff(b"strh", b"auds" + bytes(44)))

    def file(places, indexed):
        index = lambda some: b"\2\0\0\1" + len(some).to_bytes(4, "little") + b"01dc" + bytes(12) + b"".join(p.to_bytes(4, "little") + len(f).to_bytes(4, "little") for p, f in some)
        parts = [[(places[k], frames[k]) for k in range(4)], [(places[k], frames[k]) for k in range(4, 6)]]
        standard = [riff(b"ix01", index(p)) for p in parts]
        entries = b"".join(places[6 + k].to_bytes(8, "little") + len(x).to_bytes(4, "little") + bytes(4) for k, x in enumerate(standard))
        super_ = riff(b"indx", b"\4\0\0\0" + (2).to_bytes(4, "little") + b"01dc" + bytes(12) + entries) if indexed else b""
        hdrl = riff(b"LIST", b"hdrl" + sound + riff(b"LIST", b"strl" + riff(b"strh", strh) + super_))
        movi = lambda some, ix: riff(b"LIST", b"movi" + riff(b"00wb", b"noise") + b"".join(riff(b"01dc", f) for f in some) + ix)
        return riff(b"RIFF", b"AVI " + hdrl + movi(frames[:4], standard[0])) + riff(b"RIFF", b"AVIX" + movi(frames[4:], standard[1]))

    for indexed in (True, False):
        data, places = b"", [0] * 8
        for _ in range(2):  # places depend on sizes alone
            data = file(places, indexed)
            at, found = 0, []
            for f in frames:
                at = data.index(f, at)
                found.append(at)
                at += len(f)
            first = data.index(b"ix01")
            places = [*found, first, data.index(b"ix01", first + 4)]
        track = mjpeg.read_avi(data)
        assert track.fps == 30 and [a for a, _ in track.chunks] == places[:6]
        assert all((f == g).all() for f, g in zip(mjpeg.read_frames([data])[0][1], grey))


def test_a_large_frame_takes_time_in_proportion():
    import time

    flat = lambda n: baseline(np.tile(np.array([[40] * 8 + [200] * 8], np.uint8), (n, n // 16)))
    took = []
    for n in (128, 512):
        frame, began = flat(n), time.process_time()
        mjpeg.decode_frames([frame])
        took.append(time.process_time() - began)
    assert took[1] < 16 * 4 * took[0]


@pytest.mark.parametrize("kind", ["double", "date", "binary", "string"])
def test_clips_take_any_key(spark, kind):
    avi = mjpeg.write_avi([baseline(np.full((8, 8), 40, np.uint8))] * 2)
    df = spark.createDataFrame([("2024-01-02" if kind != "double" else "1.5", bytearray(avi))], "k string, media binary").withColumn("clip", F.col("k").cast(kind))
    [r] = op1_media.clips(df, "clip", "media").collect()
    assert (r["key"], r["first_frame"], r["end_frame"]) == (df.first()["clip"], 0, 2)


def test_stored_form_and_feature_by_hand():
    """The stored bytes read by a plain decoder of their own, and the feature made from the samples."""
    text = ("é shots " * 700).encode()
    padded = op1_media.payload(text)
    [media] = mjpeg.write_payloads([padded])
    at, frames, back = media.index(b"movi") + 4, [], b""
    while media[at : at + 4] == b"00dc":
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        frames.append(media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    means = []
    for f in frames:
        scan = f[f.index(b"\xff\xda") + 2 :]
        scan = scan[int.from_bytes(scan[:2], "big") : -2]
        level = b""
        for row in re.split(rb"\xff[\xd0-\xd7]", scan):
            bits, value = "".join(f"{x:08b}" for x in row.replace(b"\xff\0", b"\xff")), 128
            for _ in range(64):
                n, bits = int(bits[:4], 2), bits[4:]
                low, bits = bits[:n], bits[n:]
                value += 0 if not n else int(low, 2) if low[0] == "1" else int(low, 2) - 2**n + 1
                level += bytes([value])
        back += level
        means.append(sum(level) / len(level))
    assert back == padded
    [(fps, decoded)] = mjpeg.read_frames([media])
    shots = mjpeg.shots(decoded, fps)
    assert shots[0].first == 0 and shots[-1].end == len(frames)
    assert op1_media.feature(fps, decoded) == f"{len(frames)}|" + ",".join(f"{c.first / 25:.2f}-{c.end / 25:.2f}:{round(sum(means[c.first : c.end]) / (c.end - c.first), 3):.3f}" for c in shots)


def test_language_held_out(spark, none):
    parts = {"en": "the tion and ing er th".split(), "de": "sch ung der ein keit ü".split(), "fr": "eau oi que é les ai".split()}
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(parts[lang], 40)) + " " + " ".join(rng.choice(parts[lang], 40)), lang) for i, lang in enumerate(list(parts) * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "th " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op2_language.fit(df.where(~op2_language.held_out(df["doc_id"])), "doc_id", "text", "lang")
    got = op2_language.predict(df, "doc_id", "text", model, {"held_out": op2_language.held_out(df["doc_id"])}).collect()
    truth = {r[0]: r[2] for r in rows}
    test = [r for r in got if r.doc_id < 1000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(test) > 20 and all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in test)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), ("und", 0.0))
    assert op2_language.predict(df, "doc_id", "text", op2_language.fit(none, "doc_id", "text", "lang")).where("lang_pred <> 'und'").count() == 0
    kept = op2_language.reject_unknown(df, "doc_id", "text", "lang")
    assert kept.columns == df.columns and kept.count() == 181 and kept.where("doc_id = 1003").first().lang == "en"


def test_language_against_plain_naive_bayes(spark, corpus, none):
    from collections import Counter, defaultdict
    from math import exp, log

    given = [(r[0], r[1], r[2]) for r in corpus] + [(9000, "a" * 30_000 + " zz", None), (9001, "ÄÖ ß 12", "fr"), (None, "zeta", None)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    seen = df.where(~op2_language.held_out(df["doc_id"]))
    names, matrix = op2_language.fit(seen, "doc_id", "text", "lang")

    def bins(text):
        out, padded = [], f" {text.lower()} "
        for order in op2_language.ORDERS:
            for i in range(len(padded) - order + 1):
                h = 0
                for c in padded[i : i + order]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                h = int(op2_language.mix(np.array([(h + (order << 58)) % 2**64], np.uint64))[0])
                out.append(h >> 48)
        return out

    counts = defaultdict(Counter)
    for k, t, lang in given:
        if t is not None and lang is not None and zlib.crc32(str(k).encode()) % 4 != 2:
            counts[lang].update(bins(t))
    assert names == sorted(counts)
    totals = {x: sum(counts[x].values()) + 0.5 * op2_language.BINS for x in names}
    for r in op2_language.predict(df, "doc_id", "text", (names, matrix)).collect():
        [text] = {t or "" for k, t, _ in given if k == r.doc_id} if r.doc_id is not None else ["zeta"]
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = Counter(bins(text))
        sums = {x: sum(n * log((counts[x][b] + 0.5) / totals[x]) for b, n in found.items()) for x in names}
        best = max(sums.values())
        # float32 log-probabilities: a difference of a few parts in a million of the sum
        close = 3e-7 * abs(best) + 1e-6
        assert sums[r.lang_pred] >= best - 2 * close
        assert abs(log(r.score) + log(sum(exp(s - best) for s in sums.values()))) <= 4 * close


def test_scores_do_not_depend_on_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh ä"), int(n))) for n in rng.integers(1, 4000, 60)]
    df = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = op2_language.fit(df, "doc_id", "text", "lang")
    one = {r.doc_id: r.score for r in op2_language.predict(df.repartition(1), "doc_id", "text", model).collect()}
    assert one == {r.doc_id: r.score for r in op2_language.predict(df.repartition(9), "doc_id", "text", model).collect()}


def test_packing(docs, corpus, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op4_packing.public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for k, t, *_ in corpus:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        expected += [(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = op4_packing.packed_documents(docs, "doc_id", "text").collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 2
    assert op4_packing.packed_documents(none, "doc_id", "text").count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(5)
    for most, n in ((1024, 3000), (40, 500), (700, 50)):
        lengths, counts = np.unique(rng.integers(1, most, n), return_counts=True)
        planned = op4_packing.plan(dict(zip(lengths.tolist(), counts.tolist())))
        used = {}
        for some, times in planned:
            assert sum(some) <= 1024 and times > 0
            for x in some:
                used[x] = used.get(x, 0) + times
        assert used == dict(zip(lengths.tolist(), counts.tolist()))
        assert sum(t for _, t in planned) <= 1.02 * (lengths * counts).sum() / 1024 + 3


def test_words_encode_as_the_file_says():
    import random

    from tokenizers import Tokenizer

    whole, encode, rng = Tokenizer.from_file(op4_packing.public_tokenizers.path("byte_bpe_50k.json")), op4_packing.encoder(), random.Random(3)
    some = [*"ab ,.'s  \n\t1²½éß中😀<|>_-", " ", "　", " \n", "  ", "don't", "<|endoftext|>", " ", " "]
    for _ in range(3000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def winnowed(text):
    """(hash, place) of each mark, window by window; hashes of words and of four of them as Spark's xxhash64 chains them."""
    import struct

    import xxhash

    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    if not words:
        return []
    grams = []
    for i in range(max(1, len(words) - 3)):
        h = 42
        for w in words[i : i + 4]:
            h = xxhash.xxh64(struct.pack("<Q", w), seed=h).intdigest()
        grams.append((h >> 25, i))
    out = []
    for first in range(max(1, len(grams) - 7)):
        least = min(h for h, _ in grams[first : first + 8])
        mark = max(g for g in grams[first : first + 8] if g[0] == least)
        if mark not in out:
            out.append(mark)
    return out


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, corpus, none):
    from collections import Counter

    given = [(r[0], r[1]) for r in corpus] + [(2**63 - 1, "the last id of all " * 9), (None, "no id here " * 8), (None, "another without " * 7), (-4, "tie tie tie tie tie tie tie tie tie tie tie tie tie"), (200, "the first id given twice")] + [(corpus[3][0], "same id " * 20)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    at = lambda k: (k is None, k or 0)
    places = sorted({at(k) for k, _ in given})
    marks = {t or "": winnowed(t or "") for _, t in given}
    shown = lambda some: ",".join(f"{h}:{p}" for h, p in some)
    expected = []
    for k, t in given:
        t = t or ""
        q = len(t) // 4
        follower = places[(places.index(at(k)) + 1) % len(places)]
        longest = max(len(x or "") for y, x in given if at(y) == at(k)) // 4
        # of several texts of the next place the one whose beginning sorts first
        candidates = sorted((x or "" for y, x in given if at(y) == follower), key=lambda x: x[:longest].encode())
        edited = t[: len(t) - q] + candidates[0][:q]
        new = winnowed(edited)
        expected.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(marks[t]), shown(new), jaccard(marks[t], new), jaccard(marks[t], marks[candidates[0]])))
    assert Counter(tuple(r) for r in op6_fingerprints.compared(docs, "doc_id", "text").collect()) == Counter(expected)
    assert op6_fingerprints.compared(none, "doc_id", "text").count() == 0


def test_fingerprints_are_native(docs):
    plan = op6_fingerprints.compared(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def base_spans(t):
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    return sorted(base + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def all_spans(t, ratios):
    """Base spans and every token whose characters, one after another, are likelier as random."""
    code = {c: i for i, c in enumerate(op7_secrets._ALPHABET)}
    found, end = base_spans(t), len(code)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", t):
        if len(m[0]) >= 10:
            walk = [end, *(code[c] for c in m[0]), end]
            if sum(ratios[a, b] for a, b in zip(walk, walk[1:])) >= op7_secrets.THRESHOLD:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


PLANTED = ["plain key Zx9Qw7RtY2uVb8NmK4pL and words", "é token=Ab3dE6gH9jK2mN5pQ8sT, x", "QXZ7PLM2VKR9TWB4 alone", "see render_widget_player_value and 2024-11-28", None, "k7Gq2ZpX9w " * 40]


@pytest.fixture(scope="module")
def secrets(spark, corpus):
    given = [(r[0], r[1]) for r in corpus] + [(k, t) for k, t in enumerate(PLANTED, 5000)] + [(5000, PLANTED[0]), (None, PLANTED[1])]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    return given, df, op7_secrets.train(op7_secrets.sample_words(df, "doc_id", "text"))


def test_secrets(secrets, none):
    from collections import Counter

    given, df, ratios = secrets
    text = lambda found: ",".join(f"{op7_secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
    expected = Counter()
    for k, t in given:
        base = base_spans(t or "")
        expected[(k, *(sum(b[1] == kind for b in base) for kind in range(3)), hashlib.sha256(text(base).encode()).hexdigest(), text(all_spans(t or "", ratios)))] += 1
    assert Counter(tuple(r) for r in op7_secrets.scan(df, "doc_id", "text", ratios).collect()) == expected
    assert op7_secrets.scan(none, "doc_id", "text", ratios).count() == 0


def test_markov_models_tell_random_from_ordinary(secrets):
    _, df, ratios = secrets
    kinds = [[k for _, k, _ in x] for x in op7_secrets.spans([t or "" for t in PLANTED], ratios)]
    assert kinds == [[3], [0, 3], [3], [], [], [3] * 40]
    told = op7_secrets.evaluate(op7_secrets.sample_words(df, "doc_id", "text"), ratios)
    assert told["recall"] > 0.98 and told["precision"] > 0.99 and told["false_alarms"] < 0.001
    assert [[k for _, k, _ in x if k < 3] for x in op7_secrets.spans(["password: short secret = 'abcdefghijkl' PASSWD=ABCDEFGHIJKLMN"], ratios)] == [[0, 0]]


def test_redact(secrets, none):
    from collections import Counter

    given, df, ratios = secrets
    expected = Counter()
    for k, t in given:
        out, hidden = list(t or ""), set()
        for s, _, e in all_spans(t or "", ratios):
            hidden |= set(range(s, e))
        for i in sorted(hidden, reverse=True):
            out[i : i + 1] = [] if i - 1 in hidden else ["[SECRET]"]
        # spans that touch are one
        expected[(k, t if t is None else "".join(out), None if t is None else len("".join(out)), "mine")] += 1
    named = df.withColumn("_text", F.lit("mine")).withColumn("n", F.lit(None).cast("int")).select("doc_id", "text", "n", "_text")
    assert Counter(tuple(r) for r in op7_secrets.redact(named, "doc_id", "text", length="n").collect()) == expected
    assert op7_secrets.redact(none, "doc_id", "text").count() == 0


def test_pieces_are_lossless_and_reproducible(docs, corpus, none):
    first = {(r.doc_id): list(r.pieces) for r in op9_pieces.encoded(docs, "doc_id", "text").collect()}
    again = {(r.doc_id): list(r.pieces) for r in op9_pieces.encoded(docs.repartition(1), "doc_id", "text").collect()}
    assert first == again
    df = docs.sparkSession.createDataFrame([(k, p) for k, p in first.items()], "doc_id long, pieces array<int>")
    assert {r.doc_id: r.text for r in op9_pieces.decoded(df, "doc_id").collect()} == {r[0]: r[1] or "" for r in corpus}
    assert op9_pieces.encoded(none, "doc_id", "text").count() == 0


def ways(known, s):
    """Each segmentation of s into pieces, with its weight."""
    from math import exp

    weight = {known.bytes[i].decode("utf-8", "replace"): (i, float(w)) for i, w in zip(known.ids.tolist(), known.weights)}

    def split(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                yield from ((s[:k], *rest) for rest in split(s[k:]))

    return {tuple(weight[p][0] for p in w): exp(sum(weight[p][1] for p in w)) for w in split(s)}


@pytest.mark.parametrize("word", [" there", "    so", "   "])
def test_pieces_follow_the_lattice(word, monkeypatch):
    from collections import Counter

    known, n = op9_pieces.vocabulary(), 40000
    odds = ways(known, word)
    total = sum(odds.values())
    drawn = Counter(tuple(x.tolist()) for x in op9_pieces.encode(np.arange(n), [word[1:]] * n, known))
    assert set(drawn) <= set(odds) and max(abs(drawn[w] / n - o / total) for w, o in odds.items()) < 0.01
    # the same distribution in strips
    monkeypatch.setattr(op9_pieces, "STRIP", 2)
    drawn = Counter(tuple(x.tolist()) for x in op9_pieces.encode(np.arange(6000), [word[1:]] * 6000, known))
    assert set(drawn) <= set(odds) and max(abs(drawn[w] / 6000 - o / total) for w, o in odds.items()) < 0.03


def test_long_words_are_whole_and_lossless():
    known = op9_pieces.vocabulary()
    text = "▁ a▁b  😀" + "x" * 300 + "  " * 40 + "long" * 1500 + " " * 5000
    alone = op9_pieces.encode(np.array([7]), [text], known)[0].tolist()
    assert op9_pieces.decode(alone, known).decode() == text
    # what stands beside a text, or a longer word in it, changes nothing
    a, b = op9_pieces.encode(np.array([7, 7]), ["y" * 48, "y" * 48 + " " + "z" * 3000], known)
    assert a.tolist() == b.tolist()[: len(a)]
    assert op9_pieces.encode(np.array([1, 7]), ["z" * 9000, text], known)[1].tolist() == alone


def test_samples_are_bounded_whatever_the_ids(spark):
    from arbordex.llm.tables import sampled

    rng = np.random.default_rng(7)
    own = ["".join(rng.choice(list("abcdef "), 30)) for _ in range(20_000)]
    for rows in ([(None, t) for t in own], [(7, t) for t in own], [(None, own[0])] * 20_000 + [(i, t) for i, t in enumerate(own[:50])], [(i, t) for i, t in enumerate(own)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        n = sampled(df, "doc_id", "text", 300).count()
        assert n == min(300, len(set(rows))) or (len(set(rows)) == 51 and n <= 51)
        assert len(op7_secrets.sample_words(df, "doc_id", "text", texts=50)) <= 50 * op7_secrets.SAMPLE_WORDS
    labelled = spark.createDataFrame([(None, t, "en" if i % 100 else "rare") for i, t in enumerate(own)], "doc_id long, text string, lang string")
    counts = {r[0]: r[1] for r in sampled(labelled, "doc_id", "text", 300, "lang").groupBy("label").count().collect()}
    assert counts == {"en": 300, "rare": 200}


def test_languages_beyond_one_block(spark):
    """Blocks of languages give the result of one matrix, and more languages than a block can be learned."""
    rng = np.random.default_rng(8)
    names = [f"l{i:03}" for i in range(300)]
    alphabets = [rng.choice([chr(c) for c in range(0x4E00, 0x6000)], 6) for _ in names]
    rows = [(i, "".join(rng.choice(a, 12)), n) for i, (a, n) in enumerate(zip(alphabets * 2, names * 2))] + [(9000, None, None), (9001, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, matrix = op2_language.fit(df, "doc_id", "text", "lang")
    assert found == names and isinstance(matrix, op2_language.Blocks)
    whole = np.hstack([matrix.block(0, 200), matrix.block(200, 200)])
    one, many, few = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in op2_language.predict(df, "doc_id", "text", (found, m), block=b).collect()} for m, b in ((whole, 300), (matrix, 128), (whole, 100)))
    assert one == many == few and one[9000] == one[9001] == ("und", 0.0)
    assert sum(one[k][0] == n for k, _, n in rows if n) > 590
