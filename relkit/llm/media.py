"""Media columns: FLAC streams in a binary column, written from texts and read back as PCM blocks.

`store` writes each row's bytes (padded with 255 to a positive multiple of 576) as a
lossless FLAC stream of 8-bit samples with a seek point for every frame; `blocks` reads
the streams of a column into PCM blocks with their sample offsets; `digest` reads them
back, verifies every checksum (frame header CRC-8, frame CRC-16, MD5 of the samples) and
computes features.  A damaged stream fails the job with FlacError rather than give wrong
samples.

Scale: a scan each, nothing is shuffled.  Rows go through in groups of a few MB; of a
very long stream, frames go through in groups of 8192.

Edge cases: a null text counts as empty, its payload is 576 bytes of 255; a null media
value has no blocks and null features; equal texts give equal streams; repeated rows are
each stored; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm import flac
from relkit.llm._text import slices

_ROWS = 2048
#: Bytes of media that are decoded at once.
_BYTES = 4 << 20


def _pad(data: np.ndarray) -> np.ndarray:
    full = np.full(max(1, -(-len(data) // flac.BLOCK)) * flac.BLOCK, 255, np.uint8)
    full[: len(data)] = data
    return full


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            for lo, hi, off, raw in slices(part, "text"):
                media = flac.encode([_pad(raw[a:b]) for a, b in zip(off[:-1], off[1:])])
                yield pa.RecordBatch.from_arrays([part.column("id").slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (its FLAC stream)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_store, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", doc_id)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with a few MB of media."""
    lo, held, streams = 0, 0, []
    for i, m in enumerate(batch.column("media")):
        streams.append(m.as_py())
        held += len(streams[-1] or b"")
        if held > _BYTES or len(streams) == _ROWS or i + 1 == batch.num_rows:
            yield batch.slice(lo, len(streams)), streams
            lo, held, streams = i + 1, 0, []


def _decoded(streams: list[bytes | None]) -> list[tuple[dict, np.ndarray] | None]:
    found = iter(flac.decode([s for s in streams if s is not None]))
    return [None if s is None else next(found) for s in streams]


def _blocks(samples_per_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, streams in _groups(batch):
                out: list[list] = [[], [], [], []]
                for i, got in enumerate(_decoded(streams)):
                    for at in range(0, len(got[1]) if got else 0, samples_per_block):
                        x = got[1][at : at + samples_per_block]
                        for column, value in zip(out, (i, at, len(x), x.astype(np.int8 if got[0]["width"] <= 8 else "<i2" if got[0]["width"] <= 16 else "<i4").tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["id", "sample_offset", "n_samples", "pcm"])

    return run


def blocks(media: DataFrame, *, doc_id: str = "doc_id", samples_per_block: int = 4 * flac.BLOCK) -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (signed little-endian) for each block of each stream."""
    kind = media.schema[doc_id].dataType.simpleString()
    rows = media.select(F.col(doc_id).alias("id"), "media")
    return rows.mapInArrow(_blocks(samples_per_block), f"id {kind}, sample_offset bigint, n_samples bigint, pcm binary").withColumnRenamed("id", doc_id)


def _feature(x: np.ndarray) -> str:
    """Samples, least, greatest, mean, energy and sign changes: integers or rounded sums, equal for equal samples."""
    return f"n={len(x)};min={x.min()};max={x.max()};mean={x.sum() / len(x):.3f};rms={np.sqrt((x * x).sum() / len(x)):.3f};zc={int(((x[1:] ^ x[:-1]) < 0).sum())}"


_DIGEST = [("id", None), ("n_bytes", None), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, streams in _groups(batch):
            out: list[list] = [[] for _ in range(6)]
            for stream, got in zip(streams, _decoded(streams)):
                if got is None:
                    values = (None,) * 6
                else:
                    payload = (got[1] + 128).astype(np.uint8).tobytes()
                    values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), _feature(got[1]))
                for column, value in zip(out, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("n_bytes"), *(pa.array(x, t) for x, (_, t) in zip(out, _DIGEST[2:]))], names=[n for n, _ in _DIGEST])


def digest(media: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """What `store` gave, read back: payload and media sizes and digests, and a feature string."""
    kind = media.schema[doc_id].dataType.simpleString()
    rows = media.select(F.col(doc_id).alias("id"), "n_bytes", "media")
    found = rows.mapInArrow(_digest, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return found.withColumnRenamed("id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
