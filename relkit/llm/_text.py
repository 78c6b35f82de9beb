"""Word windows over Arrow text batches, shared by the corpus operators.

Texts reach Python as Arrow batches.  Everything here works on the UTF-8 bytes of a
slice of such a batch with numpy, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from relkit.plans.shared import shared_dir

#: Bytes of text that are handled at once in a Python worker (one longer text stays whole).
SLICE_BYTES = 2 << 20
#: Bytes that are hashed at once; bounds the temporary arrays for one very long text.
HASH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C13
_PLACE = np.uint64(0xD1B54A32D192ED03)
#: The first n of 8 little-endian bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Words of the decontamination contract: digits, letters and every byte from 0x80 on.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words between ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_STASHED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/relkit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STASHED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing lazy reads any more."""
    for table in tables:
        path = _STASHED.pop(table, None)
        if path:
            spark = table.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in batches of 1,000 rows at most: what a worker holds at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def trim() -> None:
    """Give memory that is free in this worker back to the system, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  not every libc has it
except (OSError, AttributeError):
    _LIBC = None


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) for runs of rows of at most `most` bytes; null counts as empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]
        lo = hi
    trim()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a sum over 8-byte pieces, each mixed with its place, so no pattern of bytes cancels out."""
    whole = np.ndarray((len(data) + 1,), np.uint64, np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    sizes = ends - starts
    out = mix(whole[starts] & _FIRST[np.minimum(sizes, 8)])
    long = np.flatnonzero(sizes > 8)
    pieces = (sizes[long] - 1) >> 3
    upto = np.cumsum(pieces)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, HASH_BYTES >> 3):
        n = np.arange(lo, min(lo + (HASH_BYTES >> 3), int(upto[-1])))
        of = np.searchsorted(upto, n, "right")
        nth = n - (upto[of] - pieces[of]) + 1
        left = sizes[long[of]] - 8 * nth
        said = mix((whole[starts[long[of]] + 8 * nth] & _FIRST[np.minimum(left, 8)]) ^ mix(nth.astype(np.uint64) * _PLACE))
        head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        out[long[of[head]]] += np.add.reduceat(said, head)
    return mix(out + sizes.astype(np.uint64) * _PLACE)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = sizes > 0
    s, n = starts[some], sizes[some]
    if len(s):
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        out[at[0]] = s[0]
        out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
        np.cumsum(out, out=out)
    return out


class Words:
    """The words of consecutive texts: byte ranges, the text each belongs to, and 64-bit hashes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, word_bytes: np.ndarray):
        inside = word_bytes[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.data = data
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets, self.inside = offsets, inside

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def joined(self) -> list[bytes]:
        """Each text's words, joined by one space."""
        keep = np.append(self.inside, False)
        keep[self.ends] = True
        keep[self.offsets] = False
        keep[self.starts] = True
        at = np.concatenate(([0], np.cumsum(keep[:-1])))[self.offsets].tolist()
        said = np.where(self.inside, self.data, 0x20).astype(np.uint8)[keep[:-1]].tobytes()
        return [said[a:b].rstrip(b" ") for a, b in zip(at, at[1:])]

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all belong to one text (len - k + 1 of each)."""
        n = max(0, len(self) - k + 1)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return window_hashes(self.hashes, k), self.text[:n] == self.text[k - 1 :]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:-1]) > 0
