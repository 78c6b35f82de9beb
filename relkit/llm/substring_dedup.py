"""Substring dedup on the De Bruijn graph of the corpus: edges are token k-mers.

An edge is k consecutive words (k = 13), its end nodes the k-1 words at either end.  An
edge is *repeated* where it also starts in a document with a smaller doc_id; its *source*
is its first place there (document, word).  Repeated edges of a document whose sources
follow one another as they do are one path: no branch is taken between them.

1. `solid anchors`: each edge is represented by its minimizer, the m-gram with the least
   hash in it.  An edge that is in two documents has the same minimizer in both, so
   only edges whose minimizer is in two documents at least go on.  (Of random order, a
   minimizer is one of about five words, so this shuffles a fifth of the words.)
2. `repeated edges`: the remaining edges meet their copies in a join by edge; each comes
   back to the documents that are not its first, with the coordinates of its source.
3. `compact`: per document, edges that follow one another both there and at their source
   become paths.  They end at every 64th word of the source too, so that many
   copies of a document, however they differ, ask for few distinct spans of it.
4. `verify`: each path's words, as a 128-bit cryptographic digest, are compared with the
   words at its source coordinates, in a join by source document.  Edges of a path that
   differs are *doubted*: all their copies meet again by the digest of their words.
5. `cut`: words that repeated edges cover are cut out of their documents, by a join by
   document; of doubted edges only those whose digest is in an earlier document.

Scale: the shuffles by edge are by a hash that is spread evenly.  Before each, copies of
an edge within a slice of the input become one row with the list of its documents, so a key
that a third of all documents hold arrives as one row for each slice; the reducing side
is a scan in sort order that keeps one row at a time, whatever a key's size.  Texts are
shuffled once, compressed; all joins by document read that one exchange.

Edge cases: a null text has no words.  A null doc_id has no order, so such a document
keeps all its words and is no source for others.  Rows with the same doc_id count as one
document: they are no sources for each other (paths that mix such rows are doubted, and so
decided by their words).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from relkit.llm._text import NONSPACE, Words, covered, sliding_min, slices

K = 13
#: Words of the m-grams that minimizers are chosen from.
M = 5
#: Bytes of text whose equal edges are put together before a shuffle.
SLICE = 4 << 20
#: Places of a source at which paths end.
BLOCK = 64
#: Bits of an edge's hash; fewer are for tests, which need edges that collide.
BITS = 64


def _grouped(keys: np.ndarray, docs: np.ndarray, at: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each key with its documents in order, each once; with `at`, each is followed by the first place in it."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(head)
    bounds = np.append(heads, len(keys))
    if at is not None:
        bounds, docs = 2 * bounds, np.column_stack((docs, at[order][new])).ravel()
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(docs, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(keys[heads].view(np.int64)), lists], names=["key", "docs"])


def _lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's values begin, and the values of list columns of equal lengths; null is empty."""
    sizes = pc.fill_null(batch.column(names[0]).value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))), [batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in names]


def _digests(text: bytes, ends: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two numbers for each range of words: a digest of them, joined by one space as `text` is."""
    begins = np.concatenate(([0], ends[:-1] + 1))
    said = [hashlib.blake2b(text[x:y], digest_size=16).digest() for x, y in zip(begins[starts].tolist(), ends[starts + sizes - 1].tolist())]
    return np.frombuffer(b"".join(said), np.int64).reshape(-1, 2)


def _word_ends(words: Words, i: int) -> np.ndarray:
    """Where the words of text i end once they are joined by one space."""
    a, b = words.first[i], words.first[i + 1]
    return np.cumsum(words.ends[a:b] - words.starts[a:b] + 1) - 1


def _rows(names: str, *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=names.split())


def _short(edges: np.ndarray, bits: int) -> np.ndarray:
    return edges >> np.uint64(64 - bits) if bits < 64 else edges


def _keys(words: Words, k: int, bits: int) -> np.ndarray:
    """Edge hashes as the tables hold them."""
    return _short(words.windows(k)[0], bits).view(np.int64)


def _edges(words: Words, k: int, m: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge hash, whether it is within one text, and the hash of its minimizer."""
    edges, whole = words.windows(k)
    return _short(edges, bits), whole, sliding_min(words.windows(m)[0], k - m + 1) if len(edges) else edges


def _anchors(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for lo, _, off, raw in slices(batch, "text", SLICE):
                words = Words(off, raw, NONSPACE)
                edges, whole, least = _edges(words, k, m)
                # neighbours mostly share their minimizer: keep the first of each run before sorting
                least, of = least[whole], docs[lo + words.text[: len(edges)][whole]]
                first = np.ones(len(least), bool)
                first[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
                yield _grouped(least[first], of[first])

    return run


def _candidates(k: int, m: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            bounds, (solid,) = _lists(batch, "solid")
            solid = solid.view(np.uint64)
            for lo, hi, off, raw in slices(batch, "text", SLICE):
                words = Words(off, raw, NONSPACE)
                edges, whole, least = _edges(words, k, m, bits)
                of = words.text[: len(edges)]
                # a sorted list of (text, anchor) as one key: the text is mixed into the hash
                known = np.sort(solid[bounds[lo] : bounds[hi]] + np.repeat(np.arange(hi - lo, dtype=np.uint64) * _SPREAD, np.diff(bounds[lo : hi + 1])))
                asked = least + of.astype(np.uint64) * _SPREAD
                at = np.searchsorted(known, asked)
                keep = whole & (at < len(known))
                keep[keep] = known[at[keep]] == asked[keep]
                yield _grouped(edges[keep], docs[lo + of[keep]], (np.arange(len(edges)) - words.first[of])[keep])

    return run


_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in key order to (doc, key): all documents of keys with two at least."""
    # the key that is going on, its least document, and whether that one has been given out
    last, least, given = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, (docs,) = _lists(batch, "docs")
        of = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), np.diff(bounds))
        head = np.ones(len(of), bool)
        head[1:] = of[1:] != of[:-1]
        head[0] = of[0] != last
        group = np.cumsum(head) - 1 + (not head[0])
        firsts = docs[head] if head[0] else np.concatenate(([least], docs[head]))
        later = docs != firsts[group]
        several = np.zeros(len(firsts), bool)
        several[group[later]] = True
        if not head[0] and several[0] and not given:
            yield _rows("doc key", np.array([least], np.int64), np.array([last], np.int64))
        out = several[group] if head[0] else (several[group] & ((group > 0) | later)) | (later & (group == 0))
        given = bool(several[-1]) or (len(firsts) == 1 and not head[0] and given)
        yield _rows("doc key", docs[out], of[out])
        last, least = of[-1], firsts[-1]


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in key order to (doc, key, src, at): all documents of a key but its least, and where that has it."""
    last, src, src_at = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds, (docs,) = _lists(batch, "docs")
        docs, at = docs[::2], docs[1::2]
        of = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), np.diff(bounds) // 2)
        head = np.ones(len(of), bool)
        head[1:] = of[1:] != of[:-1]
        head[0] = of[0] != last
        group = np.cumsum(head) - 1 + (not head[0])
        firsts, places = docs[head], at[head]
        if not head[0]:
            firsts, places = np.concatenate(([src], firsts)), np.concatenate(([src_at], places))
        later = docs != firsts[group]
        yield _rows("doc key src at", docs[later], of[later], firsts[group][later], places[group][later].astype(np.int32))
        last, src, src_at = of[-1], firsts[-1], places[-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, (docs,) = _lists(batch, "docs")
        yield _rows("doc key", docs[::2], np.repeat(batch.column("key").to_numpy(zero_copy_only=False), np.diff(bounds) // 2))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        zipped = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(zipped, pa.binary())], names=["doc", "zipped"])


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches with texts instead of their packed form, a few MB at a time."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        lo, texts, held = 0, [], 0
        for i, z in enumerate(batch.column("zipped")):
            texts.append(unpack.decompress(z.as_buffer()))
            held += len(texts[-1])
            if held > most or i + 1 == batch.num_rows:
                part = batch.slice(lo, len(texts)).drop_columns(["zipped"])
                yield part.append_column("text", pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                lo, texts, held = i + 1, [], 0


def _paths(k: int, bits: int):
    """The spans that a document's repeated edges ask for at their sources, and the digest of its own words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            bounds, (keys, srcs, ats) = _lists(batch, "keys", "srcs", "ats")
            for lo, hi, off, raw in slices(batch, "text", SLICE):
                words = Words(off, raw, NONSPACE)
                edges, texts, out = _keys(words, k, bits), words.joined(), []
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    if b - a < k:
                        continue
                    mine = slice(bounds[lo + i], bounds[lo + i + 1])
                    order = np.argsort(keys[mine])
                    known, own = keys[mine][order], edges[a : b - k + 1]
                    found = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    at = np.flatnonzero(known[found] == own)
                    if not len(at):
                        continue
                    src, there = srcs[mine][order][found[at]], ats[mine][order][found[at]]
                    new = np.ones(len(at), bool)
                    new[1:] = (np.diff(at) != 1) | (np.diff(src) != 0) | (np.diff(there) != 1) | (there[1:] % BLOCK == 0)
                    heads = np.flatnonzero(new)
                    sizes = np.diff(np.append(heads, len(at))) + k - 1
                    out.append(np.column_stack((src[heads], there[heads], sizes, _digests(texts[i], _word_ends(words, i), at[heads], sizes))))
                if out:
                    yield _rows("src at size d1 d2", *np.unique(np.concatenate(out), axis=0).T.copy())

    return run


def _doubted(k: int, bits: int):
    """The edges of spans of a source whose words are not those that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            bounds, (ats, sizes, d1, d2) = _lists(batch, "ats", "sizes", "d1", "d2")
            for lo, hi, off, raw in slices(batch, "text", SLICE):
                words, edges = Words(off, raw, NONSPACE), None
                texts = words.joined()
                for i in range(hi - lo):
                    mine, n = slice(bounds[lo + i], bounds[lo + i + 1]), words.first[i + 1] - words.first[i]
                    at, size = ats[mine], sizes[mine]
                    wrong = at + size > n
                    fits = np.flatnonzero(~wrong)
                    said = _digests(texts[i], _word_ends(words, i), at[fits], size[fits])
                    wrong[fits] = (said[:, 0] != d1[mine][fits]) | (said[:, 1] != d2[mine][fits])
                    if wrong.any() and n >= k:
                        edges = _keys(words, k, bits) if edges is None else edges
                        own = edges[words.first[i] : words.first[i + 1] - k + 1]
                        yield _rows("key", np.unique(own[covered(len(own), np.minimum(at[wrong], len(own)), size[wrong] - k + 1)]))

    return run


def _told(k: int, bits: int):
    """The digests of a document's doubted edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            bounds, (doubted,) = _lists(batch, "doubted")
            for lo, hi, off, raw in slices(batch, "text", SLICE):
                words = Words(off, raw, NONSPACE)
                edges, texts = _keys(words, k, bits), words.joined()
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    if b - a >= k:
                        at = np.flatnonzero(np.isin(edges[a : b - k + 1], doubted[bounds[lo + i] : bounds[lo + i + 1]]))
                        said = np.unique(_digests(texts[i], _word_ends(words, i), at, np.full(len(at), k)), axis=0)
                        yield _rows("doc d1 d2", np.full(len(said), docs[lo + i]), *said.T.copy())

    return run


def _cut(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            out: list[list] = [[], [], [], []]
            known, (keys,) = _lists(batch, "keys")
            unsure, (doubted,) = _lists(batch, "doubted")
            sure, (d1, d2) = _lists(batch, "d1", "d2")
            for lo, hi, off, raw in slices(batch, "text", SLICE):
                words = Words(off, raw, NONSPACE)
                texts = words.joined()
                edges = _keys(words, k, bits) if known[hi] > known[lo] or unsure[hi] > unsure[lo] else None
                for i in range(lo, hi):
                    a, b = words.first[i - lo], words.first[i - lo + 1]
                    gone, ends = np.zeros(b - a, bool), _word_ends(words, i - lo)
                    if edges is not None and b - a >= k:
                        own, no = edges[a : b - k + 1], doubted[unsure[i] : unsure[i + 1]]
                        hit = np.isin(own, keys[known[i] : known[i + 1]])
                        if len(no):
                            asked = np.flatnonzero(np.isin(own, no))
                            confirmed = set(zip(d1[sure[i] : sure[i + 1]].tolist(), d2[sure[i] : sure[i + 1]].tolist()))
                            said = _digests(texts[i - lo], ends, asked, np.full(len(asked), k))
                            hit[asked] = [tuple(x) in confirmed for x in said.tolist()]
                        gone = covered(b - a, np.flatnonzero(hit), k)
                    change = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    starts, stops = change[::2], change[1::2]
                    if len(starts):
                        # the ranges that stay, each with its words still joined
                        froms, tos = np.append(0, stops), np.append(starts, b - a)
                        begins = np.append(0, ends + 1)
                        kept = b" ".join([texts[i - lo][begins[x] : ends[y - 1]] for x, y in zip(froms, tos) if y > x])
                    else:
                        kept = texts[i - lo]
                    out[0].append(b - a)
                    out[1].append(int(gone.sum()))
                    out[2].append(kept.decode())
                    out[3].append([{"start": int(x), "length": int(y - x)} for x, y in zip(starts, stops)])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc", "n_words", "n_removed", "kept", "paths"])

    return run


def _schema(keys: str, **others: DataType) -> StructType:
    """Integers that are never null, and other columns."""
    return StructType([*(StructField(x, LongType(), False) for x in keys.split()), *(StructField(x, t) for x, t in others.items())])


def dedup(docs: DataFrame, *, k: int = K, m: int = M, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: the kept words joined by one space), paths (the word ranges cut out)."""
    if not 0 < m <= k:
        raise ValueError("m must be between 1 and k")
    if not 0 < bits <= 64:
        raise ValueError("bits must be between 1 and 64")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    known = rows.where("doc is not null")
    # keys are not null, as the schemas say: no join filters them, so all joins share one exchange of the texts and one of the edges
    packed = known.mapInArrow(_packed, _schema("doc", zipped=BinaryType()))
    anchors = known.where("text is not null").mapInArrow(_anchors(k, m), _schema("key", docs=ArrayType(LongType())))
    solid = anchors.repartition("key").sortWithinPartitions("key", F.col("docs")[0]).mapInArrow(_several, _schema("doc key"))
    solid = solid.groupBy("doc").agg(F.collect_list("key").alias("solid"))
    edges = packed.join(solid, "doc").mapInArrow(_candidates(k, m, bits), _schema("key", docs=ArrayType(LongType()))).repartition("key")
    repeated = edges.sortWithinPartitions("key", F.col("docs")[0]).mapInArrow(_sources, _schema("doc key src", at=IntegerType()))
    repeated = repeated.groupBy("doc").agg(*(F.collect_list(x).alias(f"{x}s") for x in ("key", "src", "at")))

    asked = packed.join(repeated, "doc").mapInArrow(_paths(k, bits), _schema("src at size d1 d2"))
    asked = asked.distinct().groupBy(F.col("src").alias("doc")).agg(*(F.collect_list(x).alias(y) for x, y in (("at", "ats"), ("size", "sizes"), ("d1", "d1"), ("d2", "d2"))))
    doubted = packed.join(asked, "doc").mapInArrow(_doubted(k, bits), _schema("key")).distinct()
    # no semi join: it would be pushed below the exchange of the edges, which is shared
    again = edges.join(doubted, "key").mapInArrow(_members, _schema("doc key")).groupBy("doc").agg(F.collect_set("key").alias("doubted"))
    told = packed.join(again, "doc").mapInArrow(_told(k, bits), _schema("doc d1 d2"))
    told = told.withColumn("least", F.min("doc").over(Window.partitionBy("d1", "d2")))
    sure = told.where("doc > least").groupBy("doc").agg(F.collect_list("d1").alias("d1"), F.collect_list("d2").alias("d2"))

    whole = packed.join(repeated, "doc", "left").join(again, "doc", "left").join(sure, "doc", "left")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in whole.dtypes if c not in ("doc", "zipped")]
    rest = rows.where("doc is null").mapInArrow(_packed, "doc bigint, zipped binary").select("doc", "zipped", *nothing)
    cut = "doc bigint, n_words bigint, n_removed bigint, kept string, paths array<struct<start:bigint,length:bigint>>"
    out = whole.mapInArrow(_cut(k, bits), cut).unionByName(rest.mapInArrow(_cut(k, bits), cut))
    return out.withColumnRenamed("doc", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM hit),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS text FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
