"""Motion-JPEG in AVI: RIFF reading and writing, JPEG frames, shots.

Two kinds of frame are decoded: baseline DCT (SOF0 and SOF1, grey or YCbCr, any sampling) and lossless (SOF3, 8 bits, any width,
predictor and tables, components of one size); the first component is used. Frames without Huffman tables, as most motion-JPEG has,
use the standard's typical ones. Frames are found by OpenDML indexes, the idx1 index or a walk over the file, in that order.
Payloads are written as lossless frames of one layout, which are decoded together.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

WIDTH = 64
FRAME_ROWS = 16
FPS = 25
#: Bits of the code of each difference class; a fixed length keeps every row's symbols separable in lockstep.
CLASS_BITS = 4
CLASSES = 9


def _codebook() -> tuple[np.ndarray, ...]:
    """Code and bits of each difference plus 255; difference and bits of the code at the front of any 12 bits."""
    diff = np.arange(-255, 256)
    cls = np.array([int(abs(d)).bit_length() for d in diff.tolist()])
    code = (cls << cls) | np.where(diff < 0, diff + (1 << cls) - 1, diff)
    front = np.arange(1 << 12)
    c = np.minimum(front >> 8, CLASSES - 1)
    low = (front >> (8 - c)) & ((1 << c) - 1)
    return code.astype(np.int64), (cls + CLASS_BITS).astype(np.int64), np.where(low < (1 << c) >> 1, low - (1 << c) + 1, low).astype(np.int16), (c + CLASS_BITS).astype(np.int64)


_CODE, _LENGTH, _DIFF, _TAKEN = _codebook()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DHT = _segment(0xC4, bytes([0]) + bytes([0, 0, 0, CLASSES] + [0] * 12) + bytes(range(CLASSES)))
_DRI = _segment(0xDD, struct.pack(">H", WIDTH))
_SOS = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _frame_head(rows: int) -> bytes:
    return b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, rows, WIDTH, 1, 1, 0x11, 0)) + _DHT + _DRI + _SOS


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of an (n, WIDTH) array; every row restarts the predictor at 128."""
    n = len(samples)
    if not n:
        return []
    diff = np.empty(samples.shape, np.int16)
    diff[:, 0] = samples[:, 0].astype(np.int16) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:], dtype=np.int16)
    diff += 255
    code, length = _CODE[diff], _LENGTH[diff]
    row_bits = length.sum(axis=1)
    row_bytes = (row_bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(row_bytes)])
    for _ in range(2):  # four codes, of at most 48 bits, become one
        code = (code[:, ::2] << length[:, 1::2]) | code[:, 1::2]
        length = length[:, ::2] + length[:, 1::2]
    at = (base[:-1, None] * 8 + np.cumsum(length, axis=1) - length).ravel()
    code = code.ravel() << (56 - length.ravel() - (at & 7))
    out, at = np.zeros(base[-1] + 8), at >> 3
    for k in range(7):
        out += np.bincount(at + k, weights=(code >> (48 - 8 * k)) & 255, minlength=len(out))
    out = out[: base[-1]].astype(np.uint8)
    pad = row_bytes * 8 - row_bits
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    full = out == 255
    stuffed = np.zeros(len(out) + int(full.sum()), np.uint8)
    stuffed[np.arange(len(out)) + np.cumsum(full) - full] = out
    cuts = base + np.concatenate([[0], np.cumsum(full)])[base]
    raw = stuffed.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def decode_rows(rows: list[bytes]) -> np.ndarray:
    """The samples of entropy-coded rows, all rows in step."""
    n = len(rows)
    raw = np.frombuffer(b"".join(rows), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    drop = np.zeros(len(raw), bool)
    drop[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    kept = np.concatenate([raw[~drop], np.full(4, 255, np.uint8)]).astype(np.int64)
    begin = (begin - np.concatenate([[0], np.cumsum(drop)])[begin])[:-1]
    word = (kept[:-3] << 16) | (kept[1:-2] << 8) | kept[2:-1]
    at, value, out = begin * 8, np.full(n, 128, np.int16), np.empty((WIDTH, n), np.uint8)
    for k in range(WIDTH):
        bits = (word[at >> 3] >> (12 - (at & 7))) & 0xFFF
        value += _DIFF[bits]
        out[k] = value
        at += _TAKEN[bits]
    return np.ascontiguousarray(out.T)


class Track(NamedTuple):
    """What an AVI file says: frames per second and where its video chunks lie."""

    fps: float
    chunks: list[tuple[int, int]]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """A RIFF AVI of one MJPG stream with an idx1 index; each frame is a key frame."""
    biggest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, biggest * fps, 0, 0x10, len(frames), 0, 1, biggest, WIDTH, FRAME_ROWS, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, FRAME_ROWS)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, FRAME_ROWS, 1, 8, b"MJPG", WIDTH * FRAME_ROWS, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes):
    """(kind, place of the body, size) of every chunk, lists entered, through all RIFF parts of the file; lists come as their type."""
    top = 0
    while data[top : top + 4] == b"RIFF" and top + 12 <= len(data):
        size = struct.unpack_from("<I", data, top + 4)[0]
        stack = [(top + 12, min(len(data), top + 8 + size))]
        while stack:
            at, end = stack.pop()
            while at + 8 <= end:
                kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                if kind == b"LIST" and at + 12 <= end:
                    yield data[at + 8 : at + 12], at + 8, size
                    stack.append((at + 8 + size + (size & 1), end))
                    at, end = at + 12, min(end, at + 8 + size)
                else:
                    yield kind, at + 8, size
                    at += 8 + size + (size & 1)
        top += 8 + struct.unpack_from("<I", data, top + 4)[0]
        top += top & 1


def _standard_index(data: bytes, at: int) -> list[tuple[int, int]]:
    """Frame places of an OpenDML index of chunks whose body begins at `at`."""
    longs, _, kind, n = struct.unpack_from("<HBBI", data, at)
    if kind != 1 or longs != 2:
        raise ValueError("an index of another kind")
    base = struct.unpack_from("<Q", data, at + 12)[0]
    entries = np.frombuffer(data, "<u4", 2 * n, at + 24).reshape(n, 2).tolist()
    return [(base + offset, size & 0x7FFFFFFF) for offset, size in entries]


def read_avi(data: bytes) -> Track:
    """Frame places of the first video stream. Raises ValueError on other data; of a broken index the next way is used."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, walked, supers, index, stream, video = float(FPS), None, [], [], None, -1, None
    for kind, at, size in _chunks(data):
        if kind == b"movi":
            movi = at if movi is None else movi
        elif kind == b"strh":
            stream += 1
            if video is None and data[at : at + 4] == b"vids":
                video = stream
                scale, rate = struct.unpack_from("<II", data, at + 20)
                fps = rate / scale if scale and rate else fps
        elif kind == b"indx" and stream == video:
            supers.append(at)
        elif kind == b"idx1":
            index = (at, min(size, len(data) - at))
        elif kind[2:] in (b"dc", b"db") and kind[:2] == b"%02d" % (video or 0):
            walked.append((at, size))
    name = b"%02d" % (video or 0)
    inside = lambda some: some and all(0 <= a and a + n <= len(data) for a, n in some)
    found: list[tuple[int, int]] = []
    try:
        for at in supers:
            n = struct.unpack_from("<I", data, at + 4)[0]
            for k in range(n if data[at + 3] == 0 else 0):
                found += _standard_index(data, struct.unpack_from("<Q", data, at + 24 + 16 * k)[0] + 8)
    except (struct.error, ValueError):
        found = []
    if inside(found):
        return Track(fps, found)
    if index and movi is not None:
        entries = np.frombuffer(data, np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), index[1] // 16, index[0])
        entries = entries[np.isin(entries["kind"], (name + b"dc", name + b"db"))]
        # offsets count from movi, or in some files from the start of the file
        start = movi if len(entries) and entries["at"][0] < movi else 0
        found = [(start + int(a) + 8, int(n)) for a, n in zip(entries["at"], entries["size"])]
        # one index covers one RIFF part; a file of several has more frames than it lists
        if inside(found) and len(found) >= len(walked):
            return Track(fps, found)
    return Track(fps, sorted(c for c in walked if sum(c) <= len(data)))


class _Head(NamedTuple):
    sof: int
    rows: int
    columns: int
    components: list
    quant: dict
    codes: dict
    restart: int
    scan: list
    body: int
    predictor: int
    shift: int


#: The typical Huffman tables of ITU T.81, K.3 to K.6, by class and number: how many codes of 1 to 16 bits, and the
#: first symbols; the others (run of up to 15 zeros, then 1 to 10 bits) follow in ascending order.
TYPICAL = {
    0x00: ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: ("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


class Book(NamedTuple):
    """Of any 16 bits: the symbol at their front and its bits (0: none)."""

    symbols: bytes
    bits: bytes


@lru_cache(maxsize=64)
def book(counts: bytes, symbols: bytes) -> Book:
    values, sizes, at = bytearray(1 << 16), bytearray(1 << 16), 0
    lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
    for n, symbol in zip(lengths, symbols):
        width = 1 << (16 - n)
        if at + width > 1 << 16:
            raise ValueError("a Huffman table with too many codes")
        values[at : at + width], sizes[at : at + width] = bytes([symbol]) * width, bytes([n]) * width
        at += width
    return Book(bytes(values), bytes(sizes))


def typical() -> dict[int, Book]:
    out = {}
    for name, (counts, first) in TYPICAL.items():
        symbols = bytes.fromhex(first)
        if name >= 0x10:
            symbols += bytes(sorted({run << 4 | size for run in range(16) for size in range(1, 11)} - {*symbols}))
        out[name] = book(bytes(map(int, counts.split())), symbols)
    return out


def _head(frame: bytes) -> _Head:
    """The segments before the first scan; frames of one file mostly share them."""
    at = frame.find(b"\xff\xda")
    return _parsed(frame[: at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")])


@lru_cache(maxsize=256)
def _parsed(frame: bytes) -> _Head:
    at, quant, codes, restart, sof, rows, columns, components = 2, {}, typical(), 0, 0, 0, 0, []
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                codes[body[0]] = book(body[1:17], body[17:k])
                body = body[k:]
        elif marker in (0xC0, 0xC1, 0xC3):
            sof = marker
            rows, columns = struct.unpack_from(">HH", body, 1)
            components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if not (rows and columns and components):
                break
            return _Head(sof, rows, columns, components, quant, codes, restart, scan, at + 2 + size, body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15)
        at += 2 + size
    raise ValueError("not a JPEG frame that this decoder knows")


#: The order in which a JPEG block stores its coefficients (ITU T.81, figure A.6), row-major places.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8) if (p // 8 + p % 8) % 2 else (p % 8))))
_COS = np.array([[(np.sqrt(0.5) if u == 0 else 1.0) * np.cos((2 * x + 1) * u * np.pi / 16) / 2 for u in range(8)] for x in range(8)])


_OWN = book(bytes([0, 0, 0, CLASSES] + [0] * 12), bytes(range(CLASSES)))
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class _Bits:
    """Bits from a place in bytes, four bytes at a time."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
        self.at, self.end = 0, 8 * len(self.raw) - 32

    def symbol(self, book: Book) -> int:
        at = self.at
        front = int.from_bytes(self.raw[at >> 3 : (at >> 3) + 4], "big") >> (16 - (at & 7)) & 0xFFFF
        n = book.bits[front]
        if not n or at > self.end:
            raise ValueError("bad Huffman code")
        self.at = at + n
        return book.symbols[front]

    def signed(self, n: int) -> int:
        """A difference or coefficient of n bits, 16 at most."""
        if not n:
            return 0
        at = self.at
        self.at = at + n
        v = int.from_bytes(self.raw[at >> 3 : (at >> 3) + 4], "big") >> (32 - n - (at & 7)) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _intervals(body: bytes) -> list[bytes]:
    """The parts of a scan between restart markers."""
    end = body.find(b"\xff\xd9")
    return _RESTART.split(body if end < 0 else body[:end])


def _baseline(frame: bytes, h: _Head) -> np.ndarray:
    most_h, most_v = max(c[1] for c in h.components), max(c[2] for c in h.components)
    across, down = -(-h.columns // (8 * most_h)), -(-h.rows // (8 * most_v))
    first, luma_h, luma_v, luma_q = h.components[0]
    if len(h.components) == 1:  # a single component's blocks come row by row, whatever its sampling
        across, down, luma_h, luma_v = -(-h.columns // 8), -(-h.rows // 8), 1, 1
    tables = {name: (h.codes[dc], h.codes[0x10 | ac]) for name, dc, ac in h.scan}
    order = [(name, *tables[name]) for name, ch, cv, _ in h.components for _ in range(ch * cv if len(h.components) > 1 else 1)]
    parts = iter(_intervals(frame[h.body :]))
    bits, before = _Bits(next(parts)), dict.fromkeys(tables, 0)
    blocks = np.zeros((across * down * luma_h * luma_v, 64), np.int64)
    k_block = 0
    for mcu in range(across * down):
        if h.restart and mcu and mcu % h.restart == 0:
            bits, before = _Bits(next(parts)), dict.fromkeys(tables, 0)
        for name, dc, ac in order:
            before[name] += bits.signed(bits.symbol(dc))
            own = name == first
            if own:
                block = blocks[k_block]
                block[0], k_block = before[name], k_block + 1
            k = 1
            while k < 64:
                rs = bits.symbol(ac)
                if rs == 0:
                    break
                k += rs >> 4
                if rs & 15:
                    value = bits.signed(rs & 15)
                    if k > 63:
                        raise ValueError("too many coefficients in a block")
                    if own:
                        block[k] = value
                k += 1
    coefficients = np.zeros((len(blocks), 64))
    coefficients[:, ZIGZAG] = blocks * h.quant[luma_q]
    samples = np.einsum("ya,nab,xb->nyx", _COS, coefficients.reshape(-1, 8, 8), _COS)
    plane = samples.reshape(down, across, luma_v, luma_h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * luma_v * 8, across * luma_h * 8)
    rows, columns = -(-h.rows * luma_v // most_v), -(-h.columns * luma_h // most_h)
    if len(h.components) == 1:
        rows, columns = h.rows, h.columns
    return np.clip(np.rint(plane[:rows, :columns] + 128), 0, 255).astype(np.uint8)


def _lossless(frame: bytes, h: _Head) -> np.ndarray:
    """Any lossless frame whose components have one size, sample by sample."""
    if any(c[1:3] != h.components[0][1:3] for c in h.components):
        raise ValueError("a lossless frame with components of several sizes")
    books = [h.codes[dc] for _, dc, _ in h.scan]
    planes = np.zeros((len(books), h.rows, h.columns), np.int64)
    parts = iter(_intervals(frame[h.body :]))
    bits, fresh, start = _Bits(next(parts)), 0, 1 << (7 - h.shift)
    for y in range(h.rows):
        for x in range(h.columns):
            n = y * h.columns + x
            if h.restart and n and n % h.restart == 0:
                bits, fresh = _Bits(next(parts)), y
            for plane, codes in zip(planes, books):
                size = bits.symbol(codes)
                diff = 32768 if size == 16 else bits.signed(size)
                a = int(plane[y, x - 1]) if x else 0
                b = int(plane[y - 1, x]) if y > fresh else 0
                c = int(plane[y - 1, x - 1]) if x and y > fresh else 0
                if y == fresh:
                    guess = a if x and not (h.restart and n % h.restart == 0) else start
                elif not x:
                    guess = b
                else:
                    guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[h.predictor]
                plane[y, x] = (guess + diff) & 0xFFFF
    return ((planes[0] << h.shift) & 255).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame's first component; lossless frames of our own layout are decoded together."""
    heads, rows, out = [_head(f) for f in frames], [], [None] * len(frames)
    own = []
    for i, (f, h) in enumerate(zip(frames, heads)):
        if h.sof != 0xC3:
            out[i] = _baseline(f, h)
        elif (h.columns, h.restart, h.predictor, h.shift, len(h.components)) == (WIDTH, WIDTH, 1, 0, 1) and h.codes[h.scan[0][1]] == _OWN:
            parts = _intervals(f[h.body :])
            if len(parts) != h.rows:
                raise ValueError("a lossless frame with missing rows")
            rows += parts
            own.append(i)
        else:
            out[i] = _lossless(f, h)
    if rows:
        samples, at = decode_rows(rows), 0
        for i in own:
            out[i] = samples[at : at + heads[i].rows]
            at += heads[i].rows
    return out


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload (a positive multiple of WIDTH bytes): its bytes are the samples of lossless frames."""
    coded, out, at = encode_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)), [], 0
    for p in payloads:
        n, frames = len(p) // WIDTH, []
        for first in range(0, n, FRAME_ROWS):
            rows = coded[at + first : at + min(n, first + FRAME_ROWS)]
            body = b"".join(b"".join((b"\xff", bytes([0xD0 + (k - 1) % 8]), r)) if k else r for k, r in enumerate(rows))
            frames.append(_frame_head(len(rows)) + body + b"\xff\xd9")
        at += n
        out.append(write_avi(frames))
    return out


def read_frames(media: list[bytes]) -> list[tuple[float, list[np.ndarray]]]:
    """(frames per second, grey frames) of each AVI; all files of the list are decoded in step."""
    tracks = [read_avi(m) for m in media]
    frames, out = iter(decode_frames([m[a : a + s] for m, t in zip(media, tracks) for a, s in t.chunks if s])), []
    for t in tracks:
        own: list[np.ndarray] = []
        for _, size in t.chunks:
            if size or own:  # an empty chunk shows the frame before it again
                own.append(next(frames) if size else own[-1])
        out.append((t.fps, own))
    return out


class Clip(NamedTuple):
    first: int
    end: int
    start_s: float
    end_s: float
    mean: float


def shots(frames: list[np.ndarray], fps: float, bins: int = 32, memory: int = 8, factor: float = 3.0, least: float = 0.15) -> list[Clip]:
    """Clips between cuts. A cut is where the histogram difference (0 to 1) of a frame to the one before exceeds both `least`
    and the mean plus `factor` standard deviations of the last `memory` differences of its shot."""
    if not frames:
        return []
    histograms = np.stack([np.bincount((f >> 3).ravel() if bins == 32 else f.ravel() * bins // 256, minlength=bins) / f.size for f in frames])
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts, seen = [0], []
    for i, d in enumerate(change.tolist(), 1):
        recent = seen[-memory:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > least and d > mean + factor * spread and recent:
            cuts.append(i)
            seen = []
        else:
            seen.append(d)
    return [Clip(a, b, a / fps, b / fps, round(float(np.mean([f.mean() for f in frames[a:b]])), 3)) for a, b in zip(cuts, [*cuts[1:], len(frames)])]
