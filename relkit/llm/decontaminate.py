"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are what is left of a text, A-Z lower-cased, between bytes that are neither
letters nor digits (every byte from 0x80 on counts as a letter).  An item's windows are
its n consecutive words; an item of fewer words, but not none, is one window.  Each hit
of the hash set is verified against the item's words, so a hash collision is no hit.

Scale: the benchmark goes in blocks of at most `block_bytes` of its words, a bound that is
checked before a block is collected: items longer than PIECE windows are cut into pieces
that overlap by n - 1 words, and blocks are made smaller until the largest fits.  A block
is broadcast as one copy of its words with a hash and two places for each window.  With
one block, it is one scan of the documents without a shuffle.  With more, each block is a
pass of its own that writes the hits of documents that have some, so that one block is held
at a time; hits are then joined to the documents by row number.

Edge cases: a null or empty text has no words; a null item has none either and never
occurs; a null item_id occurs but is no id, neither counted nor listed; repeated rows are
each given the same result; repeated item_ids count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relkit.llm._text import ALNUM, LOWER, Words, slices, stash

N = 10
#: Most bytes of benchmark words in one broadcast, and windows in a piece of an item.
BLOCK_BYTES, PIECE = 8 << 20, 1 << 12


def _pieces(n: int, piece: int):
    """Items as their words, joined by spaces, in pieces of so many windows; those without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, said = [], []
            for lo, _, off, raw in slices(batch, "text"):
                for i, text in enumerate(Words(off, LOWER[raw], ALNUM).joined()):
                    words = text.split(b" ") if text else []
                    for at in range(0, max(1, len(words) - n + 1) if words else 0, piece):
                        ids.append(batch.column("id")[lo + i].as_py())
                        said.append(b" ".join(words[at : at + piece + n - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(said, pa.string())], names=["id", "words"])

    return run


def item_windows(items: list[tuple[str, str]], n: int) -> dict:
    """From (id, words): one copy of the words, and by window length the sorted hashes with the item and bytes of each."""
    data = " ".join(text for _, text in items).encode()
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(text.encode()) for _, text in items], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    # the space between two items belongs to the one before it
    words = Words(np.concatenate(([0], np.minimum(ends + 1, len(raw)))), raw, ALNUM)
    counts = np.diff(words.first)
    out = {}
    for k in np.unique(np.minimum(counts, n)).tolist():
        if k:
            hashes, whole = words.windows(k)
            at = np.flatnonzero(whole & (np.minimum(counts, n)[words.text[: len(hashes)]] == k))
            at = at[np.argsort(hashes[at], kind="stable")]
            out[k] = (hashes[at], words.text[at], words.starts[at], words.ends[at + k - 1])
    return {"ids": [x for x, _ in items], "data": data, "windows": out}


def find_hits(words: Words, wanted: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Word position and window length of every verified occurrence, and (text, item) of each item that occurs."""
    at, size, found = [], [], set()
    said_by, ids = wanted["data"], wanted["ids"]
    for k, (hashes, items, lows, highs) in wanted["windows"].items():
        own, whole = words.windows(k)
        sieve = np.zeros(1 << 16, bool)
        sieve[(hashes >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(own >> np.uint64(48)).astype(np.int64)] & whole)
        left, right = (np.searchsorted(hashes, own[maybe], side) for side in ("left", "right"))
        for p, a, b in zip(maybe[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
            said = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[p : p + k], words.ends[p : p + k]))
            hit = [items[x] for x in range(a, b) if said_by[lows[x] : highs[x]] == said]
            if hit:
                at.append(p)
                size.append(k)
                found.update((int(words.text[p]), ids[x]) for x in hit)
    return np.array(at, np.int64), np.array(size, np.int64), sorted(found, key=lambda x: (x[0], x[1] or ""))


_HIT = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("byte_start", T.LongType()).add("byte_end", T.LongType())
_HITS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])


def _scan(docs: DataFrame, wanted) -> DataFrame:
    """docs with the number of words, the hits as (word range, byte range), and the ids of the items that occur."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__hits", T.ArrayType(_HIT)), T.StructField("__items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            counts, offsets, parts, items = [], [0], [], []
            for lo, hi, off, raw in slices(batch, "text"):
                words = Words(off, LOWER[raw], ALNUM)
                counts.append(np.diff(words.first))
                at, size, found = find_hits(words, known)
                order = np.lexsort((size, at))
                at, size = at[order], size[order]
                of = words.text[at]
                offsets += (offsets[-1] + np.cumsum(np.bincount(of, minlength=hi - lo))).tolist()
                base, begin = words.first[of], off[of]
                parts.append(pa.StructArray.from_arrays([pa.array(at - base, pa.int32()), pa.array(at + size - base, pa.int32()), pa.array(words.starts[at] - begin, pa.int64()), pa.array(words.ends[at + size - 1] - begin, pa.int64())], fields=list(_HITS)))
                own: list[list] = [[] for _ in range(hi - lo)]
                for i, x in found:
                    own[i].append(x)
                items += own
            flat = pa.concat_arrays(parts) if parts else pa.array([], _HITS)
            more = [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__n_words", "__hits", "__items"])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, ...) and three more columns: `__n_words`, `__hits` (each verified occurrence of a window) and `__items` (their ids)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    items = stash(items.mapInArrow(_pieces(n, PIECE), "id string, words string").distinct(), "benchmark")
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    while blocks > 1 or total > block_bytes:
        largest = items.groupBy(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)).alias("block")).agg(F.sum(F.octet_length("words")).alias("bytes"), F.count("*").alias("n")).agg(F.max("bytes"), F.max("n")).first()
        if largest[0] <= block_bytes or largest[1] == 1:
            break
        blocks *= 2
    rows = docs if blocks == 1 else stash(docs.select(F.monotonically_increasing_id().alias("__id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")), "documents")
    passes = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == b)
        wanted = spark.sparkContext.broadcast(item_windows([tuple(r) for r in part.collect()], n))
        if blocks == 1:
            return _scan(docs, wanted)
        found = _scan(rows.select("__id", F.col("__row.text").alias("text")), wanted).drop("text")
        # every row is there once with its number of words, and once for each block that hits it
        passes.append(stash(found if not b else found.where("size(__hits) > 0").withColumn("__n_words", F.lit(None).cast("bigint")), "hits"))
        wanted.destroy()
    met = passes[0]
    for more in passes[1:]:
        met = met.union(more)
    met = met.groupBy("__id").agg(F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__hits")).alias("__hits"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    return rows.join(met, "__id").select("__row.*", "__n_words", "__hits", "__items")


def _n_hit(hits: str) -> Column:
    """Words in the union of the hits' ranges."""
    step = f"aggregate(array_sort(transform({hits}, h -> struct(h.start as s, h.end as e))), named_struct('n', 0L, 'to', 0), (a, h) -> named_struct('n', a.n + greatest(0, h.e - greatest(h.s, a.to)), 'to', greatest(a.to, h.e)), a -> a.n)"
    return F.expr(step)


def report(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    found = scan(docs.select("doc_id", F.col(text).alias("text")), benchmark, **options)
    ids = "array_sort(filter(__items, x -> x is not null))"
    return found.select("doc_id", F.col("__n_words").alias("n_words"), _n_hit("__hits").alias("n_hit"), F.expr(f"cast(size({ids}) as bigint)").alias("n_items"), F.expr(f"sha2(array_join({ids}, ','), 256)").alias("items_sha256"), F.expr("size(__hits) > 0").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without its contaminated rows, or (remove='spans') without the words that were hit; all columns are kept."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = scan(docs.select(whole.alias("row"), F.col(text).alias("text")), benchmark, **options)
    if remove == "documents":
        return found.where("size(__hits) = 0").select("row.*")
    # spans are byte ranges: keep what lies between them
    ranges = "array_sort(transform(__hits, h -> struct(h.byte_start as s, h.byte_end as e)))"
    raw = "encode(text, 'UTF-8')"
    kept = f"aggregate({ranges}, named_struct('out', cast('' as binary), 'to', 0L), (a, h) -> named_struct('out', concat(a.out, substring({raw}, cast(a.to + 1 as int), cast(greatest(0L, h.s - a.to) as int))), 'to', greatest(a.to, h.e)), a -> decode(concat(a.out, substring({raw}, cast(a.to + 1 as int), 2147483647)), 'UTF-8'))"
    return found.select(F.col("row").withField(f"`{text}`", F.when(F.expr("size(__hits) > 0"), F.expr(kept)).otherwise(F.col("text"))).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
bh AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM bh),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN bh ON bh.k = dw.k AND bh.s = array_to_string(w[p:p + dw.k - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(item_id) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
