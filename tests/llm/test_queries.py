"""The registered queries themselves, over a table of several files: what their contracts fix, by brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbordex.llm import op1_media, op2_language, op4_packing, op5_jaccard, op6_fingerprints, op7_secrets, op8_suffixes, op9_pieces


@pytest.fixture(scope="module")
def given(corpus):
    """Rows with ids of their own, as the contracts' joins by doc_id need; the texts still hold copies, nulls and ties."""
    return list({r[0]: r for r in corpus}.values())


@pytest.fixture(scope="module")
def folder(spark, given, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_media(spark, folder, given):
    got = {r.doc_id: r for r in op1_media.op1_media(spark, folder).collect()}
    assert len(got) == len(given)
    features = defaultdict(set)
    for k, t, *_ in given:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and re.fullmatch("[0-9a-f]{64}", r.media_sha256)
        features[raw].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(x) == 1 for x in features.values())


def test_language_never_sees_the_held_out_quarter(spark, folder, given, tmp_path):
    got = {r.doc_id: r for r in op2_language.op2_language(spark, folder).collect()}
    for k, t, *_ in given:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert (got[k].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and got[k].lang_pred in ("und", "en", "de") and 0 <= got[k].score <= 1
    changed = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang, s, n) for k, t, lang, s, n in given]
    spark.createDataFrame(changed, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    again = {r.doc_id: r for r in op2_language.op2_language(spark, str(tmp_path)).collect()}
    assert {k: (r.lang_pred, r.score) for k, r in got.items()} == {k: (r.lang_pred, r.score) for k, r in again.items()}


def test_packing(spark, folder, given):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op4_packing.public_tokenizers.path("byte_bpe_50k.json"))
    expected, tokens = [], 0
    for k, t, *_ in given:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        tokens += len(ids)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        expected += [(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = op4_packing.op4_packing(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for some in sequences.values():
        ends = np.cumsum([n for _, n in sorted(some)])
        assert [o for o, _ in sorted(some)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(sequences) <= -(-tokens // 1024) + 1


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_jaccard(spark, folder, given):
    sets = {k: shingles(t) for k, t, *_ in given}
    least = {k: k for k in sets}
    keys = sorted(sets)
    for _ in keys:
        before = dict(least)
        for a in keys:
            for b in keys:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard.op5_jaccard(spark, folder).collect()} == {k: (len(sets[k]), least[k]) for k in keys}


def test_fingerprints(spark, folder, given):
    rows = sorted((r[0], r[1] or "") for r in given)
    got = {r.doc_id: r for r in op6_fingerprints.op6_fingerprints(spark, folder).collect()}
    hashes = lambda shown: {m.split(":")[0] for m in shown.split(",") if m}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[1][:q]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited.encode()))
        for other, near in ((hashes(r.edited_fingerprint), r.near_edited), (hashes(got[after[0]].fingerprint), r.near_next)):
            own = hashes(r.fingerprint)
            assert near == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
    by_text = defaultdict(set)
    for k, t in rows:
        by_text[t].add(got[k].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_secrets(spark, folder, given):
    kinds = (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12), ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16))
    got = {r.doc_id: r for r in op7_secrets.op7_secrets(spark, folder).collect()}
    for k, t, *_ in given:
        base = sorted((m.start(), order, m.end()) for order, (_, pattern, group, least) in enumerate(kinds) for m in re.finditer(pattern, t or "") if len(m[group]) >= least)
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(o == n for _, o, _ in base) for n in range(3))
        shown = [f"{kinds[o][0]}:{a}:{z}" for a, o, z in base]
        assert r.base_sha256 == sha(",".join(shown).encode()) and set(shown) <= set(r.spans.split(",")) | {""}


def test_suffixes(spark, folder, given):
    seen = Counter()
    raws = {r[0]: (r[1] or "").encode() for r in given}
    for raw in raws.values():
        seen.update(raw[i : i + 200] for i in range(len(raw) - 199))
    for r in op8_suffixes.op8_suffixes(spark, folder).collect():
        raw = raws[r.doc_id]
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), sha(kept))


def test_pieces_come_back(spark, folder, given):
    got = op9_pieces.op9_pieces(spark, folder)
    assert got.count() == len(given) and {r.doc_id for r in got.select("doc_id").collect()} == {r[0] for r in given}
