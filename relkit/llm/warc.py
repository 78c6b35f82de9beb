"""WARC archives compressed record by record with a shared Zstandard dictionary.

`write` makes archives (one row each, at most about ARCHIVE_BYTES long): a leading
skippable frame that holds the dictionary, then one Zstandard frame for each record, so
a record can be read alone by its offset.  The dictionary is built from a sample of about
SAMPLE distinct payloads of at most SAMPLE_BYTES, picked by their digest: a bounded fit
whatever ids or payloads repeat; a page that is not in the sample is stored in full all
the same.  `read` takes the archives apart
again and verifies the digest of every payload.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest
page_id is a response and the others are revisits that refer to it.

Scale: digests are pre-aggregated before the shuffle that finds the first page of each,
only those that occur again are joined to the pages, and a payload that a third of the
pages hold is a skewed join key, which Spark splits.  An archive is bounded, whatever a
partition holds, unless one page is longer.

Edge cases: a null html is an empty payload; a null url leaves the field out; rows with a
null page_id are responses to which nothing refers; rows with the same page_id and payload
are all responses or all revisits; an empty table gives no archive; extra columns are
ignored; control characters in an url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm._text import stash

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
SAMPLE = 1000
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the head of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' ends themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _write(dictionary: bytes, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        lead = DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if known else b""
        frames, at, pages, offsets = [lead], len(lead), [], []

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.large_binary()).cast(pa.binary()), pa.array([pages], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64()))], names=["content", "pages", "offsets"])

        for batch in batches:
            for page, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page", "url", "html", "payload_digest", "refers_to"))):
                frame = pack.compress(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py(), date))
                pages.append(page.as_py())
                offsets.append(at)
                frames.append(frame)
                at += len(frame)
                if at >= archive_bytes:
                    yield archive()
                    frames, at, pages, offsets = [lead], len(lead), [], []
        if pages:
            yield archive()

    return run


def write(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the pages: content (the bytes of a .warc.zst file), and the page and offset of each record."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    digested = rows.withColumn("payload_digest", F.sha2("html", 256))
    # written, so that both sides of the join are dealt anew and Spark can split the rows of a hot payload
    firsts = digested.where(F.octet_length("html") >= min_revisit).groupBy("payload_digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    firsts = stash(firsts, "payloads")
    typed = digested.join(firsts, "payload_digest", "left").withColumn("refers_to", F.expr("if(page <> first, first, null)"))
    short = rows.where(F.octet_length("html") <= SAMPLE_BYTES).select("html")
    n = short.agg(F.approx_count_distinct("html")).first()[0]
    sample = short.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30)).distinct()
    texts = [record(None, None, r.html.encode(), "", None, date) for r in sample.collect()]
    return typed.select("page", "url", "html", "payload_digest", "refers_to").mapInArrow(_write(build_dictionary(sorted(texts)), date, archive_bytes), "content binary, pages array<bigint>, offsets array<bigint>")


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of an archive."""
    known, at = None, 0
    if int.from_bytes(archive[:4], "little") == DICTIONARY_FRAME:
        at = 8 + int.from_bytes(archive[4:8], "little")
        raw = archive[8:at]
        if raw[:4] == zstandard.FRAME_HEADER:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=known).stream_reader(archive[at:], read_across_frames=True)
    held, end = bytearray(), False
    while True:
        cut = held.find(b"\r\n\r\n")
        size = None
        if cut >= 0:
            lines = held[:cut].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise WarcError("no record at its place")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = cut + 4 + int(fields["Content-Length"]) + 4
        if size is not None and len(held) >= size:
            yield fields, bytes(held[cut + 4 : size - 4])
            del held[:size]
        elif end:
            if held:
                raise WarcError("the last record is cut off")
            return
        else:
            more = reader.read(1 << 20)
            end = not more
            held += more


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out: list[list] = [[] for _ in range(7)]
            for fields, block in parse(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise WarcError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
                for column, value in zip(out, (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), None if revisit else payload)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(archives: DataFrame) -> DataFrame:
    """The records of archives(content): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    return archives.select("content").mapInArrow(_read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stash(write(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
