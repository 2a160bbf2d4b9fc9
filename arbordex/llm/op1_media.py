"""Operator 1, media columns: AVI motion-JPEG in and out of binary columns.

`clips` turns a binary column of AVI files into one row for each shot. `digests` stores texts as lossless motion-JPEG, reads
the stored bytes back and describes them. Both are narrow: no shuffle, and memory is bounded by one pass of media.

Null or empty text: a payload of 64 zero bytes. Null media: no clips. Media that can't be read: one clip row with its error.
Equal texts give equal values; other columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arbordex.llm import mjpeg
from arbordex.llm.columns import buffers, passes
from arbordex.llm.tables import mapped, table

CLIPS = "clip int, first_frame int, end_frame int, start_s double, end_s double, mean_level double, error string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Payload bytes that are encoded and decoded in step.
STEP = 1 << 19


def clips(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, clip, first_frame, end_frame, start_s, end_s, mean_level, error) of each shot of each AVI file. The key may be of any
    type; if it has the name of another of these columns, it comes out as `key`."""
    names = [c.split()[0] for c in CLIPS.split(", ")]

    def run(batches):
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                m = b.column(1)[i].as_py()
                if m is None:
                    continue
                try:
                    [(fps, frames)] = mjpeg.read_frames([m])
                    rows += [(i, k, c.first, c.end, c.start_s, c.end_s, c.mean, None) for k, c in enumerate(mjpeg.shots(frames, fps))]
                except (ValueError, KeyError, IndexError, StopIteration, mjpeg.struct.error) as e:
                    rows.append((i, *[None] * 6, str(e) or type(e).__name__))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], ["key", *names])

    source = df.select(df[key].alias("key"), df[media].cast("binary").alias("media"))
    return mapped(source, run, f"key {dict(source.dtypes)['key']}, {CLIPS}").withColumnRenamed("key", "key" if key in names else key)


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 if text else 64)


def feature(fps: float, frames: list) -> str:
    """Frames, then start-end seconds and mean level of each clip."""
    return f"{len(frames)}|" + ",".join(f"{c.start_s:.2f}-{c.end_s:.2f}:{c.mean:.3f}" for c in mjpeg.shots(frames, fps))


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """What DIGEST lists, for each row: the text stored as motion-JPEG, read back and described."""

    def run(batches):
        for b in batches:
            data, offsets = buffers(b.column(1))
            ids = b.column(0).to_pylist()
            for first, end, part, at in passes(data, offsets, STEP):
                raw, at = part.tobytes(), at.tolist()
                payloads = [payload(raw[x:y]) for x, y in zip(at, at[1:])]
                media = mjpeg.write_payloads(payloads)
                rows = []
                for i, (k, m, (fps, frames)) in enumerate(zip(ids[first:end], media, mjpeg.read_frames(media))):
                    back = b"".join(f.tobytes() for f in frames)
                    rows.append((k, at[i + 1] - at[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(fps, frames)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return mapped(df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")), run, DIGEST)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text")
