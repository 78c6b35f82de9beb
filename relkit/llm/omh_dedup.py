"""Near-duplicate documents by Order MinHash (Marcais et al., 2019), verified by banded alignment.

Words are runs of letters, digits and bytes from 0x80 on, A-Z lower-cased.  A shingle is
five consecutive words (a shorter text is one shingle), labelled with its occurrence
number, so the shingles of a text differ.  A sketch takes the three labelled shingles of
least hash and keeps them in text order: it depends on order, as edit similarity does.
Texts that have one of SKETCHES sketches in common are candidates.

Two texts are linked if a banded alignment of their shingle sequences matches L shingles
with L / (n1 + n2 - L) >= 0.8.  A pair at 0.8 shares a sketch with probability about
0.51, so all 24 miss it about 3 times in 10**8.

Scale: texts of the same words are one *representative* from the start.  In a bucket each
member is compared with two pivots, never with all others: the *hub*, which has most
companions over all its buckets (the original of a group of copies that each differ from
it, and by more from each other), and one picked by hash.  Connected components join the
links up.  A bucket whose members are still in several groups is *open*: the members of
open buckets meet again in narrower ones, of 4 neighbouring sketches that agree, with
pivots of their own.  Unrelated texts part there, and a round only has what the one before
left open.  Bucket counts, pivots and labels are pre-aggregated and joined
back, so a hot bucket is a skewed join key, which Spark splits.  Texts stay where they
are: what is shuffled is 200 bytes of sketches a document, and the packed shingles of
documents that are in a candidate pair.

Pivots are the cheap first step and may miss links; the last one misses none.  The members
of buckets that are open in the end meet by a prefix filter: shingles are put in one order,
rarest first by counts in PLACES hashed places, and two texts at 0.8 or more have one of
their first n - ceil(0.8 n) + 1 shingles in common.  Pairs of one group, or too far apart
in length or position for 0.8, are left out of that join, which has on one side only what
is outside the largest group of its key; all others are aligned.

Edge cases: a null, empty or wordless text is linked to nothing and is a class of its own;
a null doc_id gets a null class and is linked to nothing; rows with the same doc_id and
words share their class; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm._text import ALNUM, LOWER, Words, discard, gather, mix, slices, stash
from relkit.llm.components import components

K = 5
SIMILARITY = 0.8
SKETCHES = 24
PER_SKETCH = 3
#: Neighbouring sketches that agree in a bucket, round by round.
DEPTHS = (1, 4)
#: Hashed places in which shingles are counted, and how many a row of counts holds.
PLACES, _ROW = 1 << 20, 1 << 10
#: Most candidate ids that are broadcast to pick their documents (16 bytes each); beyond, a shuffled join.
BROADCAST_IDS = 2_000_000

_SEEDS = np.random.default_rng(61).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOST = np.uint64(2**64 - 1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes in text order, and where each text's begin (one more than texts)."""
    hashes, whole = words.windows(k)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    pos, of = np.flatnonzero(whole), words.text[: len(hashes)][whole]
    got = hashes[whole]
    if len(short):
        own = np.array([mix(np.array([np.bitwise_xor.reduce(words.hashes[a:b] * _SEEDS[: b - a])], np.uint64))[0] for a, b in zip(words.first[short], words.first[short + 1])], np.uint64)
        of, pos, got = np.concatenate((of, short)), np.concatenate((pos, words.first[short])), np.concatenate((got, own))
        order = np.argsort(pos, kind="stable")
        of, got = of[order], got[order]
    order = np.lexsort((got, of))
    same = np.zeros(len(got), bool)
    same[1:] = (got[order][1:] == got[order][:-1]) & (of[order][1:] == of[order][:-1])
    if same.any():
        at = np.arange(len(got))
        begin = np.maximum.accumulate(np.where(same, 0, at))
        nth = np.empty(len(got), np.uint64)
        nth[order] = (at - begin).astype(np.uint64)
        got = np.where(nth > 0, mix(got + nth * _SEEDS[-1]), got)
    return got, np.searchsorted(of, np.arange(len(words.first)))


def sketches(labels: np.ndarray, first: np.ndarray, count: int, least: int) -> np.ndarray:
    """texts x count hashes, each of the `least` labels of least hash in text order; texts without labels get zeros."""
    have = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, count), np.uint64)
    if not len(have):
        return out
    begin, of = first[have], np.repeat(np.arange(len(have)), np.diff(first)[have])
    for f in range(count):
        values = (labels ^ _SEEDS[f]) * _SEEDS[f + count]
        values ^= values >> np.uint64(32)
        values *= _SEEDS[f + 2 * count]
        picked = np.full((len(have), least), len(labels))
        for j in range(least):
            low = np.minimum.reduceat(values, begin)
            at = np.flatnonzero((values == low[of]) & (values != _MOST))
            texts, one = np.unique(of[at], return_index=True)
            picked[texts, j] = at[one]
            values[at] = _MOST
        picked.sort(axis=1)
        total = np.zeros(len(have), np.uint64)
        for j in range(least):
            total = mix(total * _SEEDS[0] + np.where(picked[:, j] < len(labels), labels[np.minimum(picked[:, j], len(labels) - 1)], np.uint64(0)))
        out[have, f] = mix(total + np.uint64(f))
    return out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """L / (n1 + n2 - L) for the longest alignment within the band that `similarity` allows, or 0 if below it."""
    n = len(a) + len(b)
    need = int(np.ceil(similarity / (1 + similarity) * n - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    band = max(len(a), len(b)) - need
    _, at, to = np.intersect1d(a, b, return_indices=True)
    near = np.abs(at - to) <= band
    to = to[near][np.argsort(at[near], kind="stable")]
    matched = len(to)
    if matched >= need and not (to[1:] > to[:-1]).all():
        tails: list[int] = []
        for x in to.tolist():
            i = bisect_left(tails, x)
            tails[i : i + 1] = [x]
        matched = len(tails)
    return matched / (n - matched) if matched >= need else 0.0


def _sketched(k: int, count: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, raw in slices(batch, "text"):
                words = Words(off, LOWER[raw], ALNUM)
                labels, first = shingles(words, k)
                found = sketches(labels, first, count, least)
                some = np.diff(words.first) > 0
                # a cryptographic digest of the words themselves: equal for texts of the same words alone
                digest = [hashlib.blake2b(x, digest_size=32).digest() for x in words.joined()]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), pa.array([x if s else None for x, s in zip(digest, some)], pa.binary()), pa.array([x.tobytes() if s else None for x, s in zip(found, some)], pa.binary())], names=["doc", "digest", "sketch"])

    return run


def _buckets(depth: int):
    """A bucket for each sketch and the depth - 1 that follow it, around the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("sketch")])
                key = found
                for j in range(1, depth):
                    key = mix(key * _SEEDS[0] + np.roll(found, -j, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), found.shape[1]))], names=["bucket", "rep"])

    return run


def _met(reps: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets of two at least, (bucket, rep, n, some), and pairs(a, b) of each with its bucket's pivots."""
    buckets = reps.select("rep", "sketch").mapInArrow(_buckets(depth), "bucket bigint, rep bigint")
    # written, as are hubs and members, so that both sides of a join are dealt anew and Spark can split the rows of a hot bucket
    shared = stash(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(depth))).alias("some")).where("n > 1"), "buckets")
    members = stash(buckets.join(shared, "bucket"), "members")
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = stash(members.join(company, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("hub")), "hubs")
    met = members.join(hubs, "bucket").select("rep", F.explode(F.array("some", "hub")).alias("pivot")).where("rep <> pivot")
    return members, met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs(a, b) with the groups la and lb of their ends, where these differ."""
    ends = [labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").where("la <> lb")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels(id, label) with the groups at both ends of found(a, b) joined up."""
    between = _labelled(stash(found, "links"), labels).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    joined = components(between).select(F.col("id").alias("label"), F.col("label").alias("to"))
    out = stash(labels.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    discard(labels)
    return out


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, label) of the members of buckets that are in several groups."""
    grouped = stash(members.join(labels, members.rep == labels.id).select("bucket", "rep", "label"), "grouped")
    still = stash(grouped.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"), "open")
    return stash(grouped.join(still, "bucket").select("rep", "label").distinct(), "left")


def _groups(docs: DataFrame, reps: DataFrame, depths: tuple[int, ...], **options) -> DataFrame:
    """(id, label) of reps(rep, sketch): the least rep that links of docs(doc, text) lead to."""
    labels, left, tried, widest = reps.select(F.col("rep").alias("id"), F.col("rep").alias("label")).distinct(), reps, None, None
    for depth in depths:
        members, pairs = _met(left, depth)
        if tried is None:
            widest = members
        else:
            pairs = _labelled(pairs, labels).select("a", "b").join(tried, ["a", "b"], "left_anti")
        pairs = stash(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        labels = _merged(labels, links(docs, pairs, **options))
        if depth == depths[-1]:
            break
        left = stash(reps.join(_open(members, labels).select("rep"), "rep").select("rep", "sketch"), "left")
        if left.isEmpty():
            break
    last = _open(widest, labels)
    if last.isEmpty():
        return labels
    pairs = stash(_near(docs, last, **options).join(tried, ["a", "b"], "left_anti"), "pairs")
    return _merged(labels, links(docs, pairs, **options))


def _frequencies(k: int):
    """How many shingles fall in each place, _ROW places a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for _, _, off, raw in slices(batch, "text"):
                labels, _ = shingles(Words(off, LOWER[raw], ALNUM), k)
                total += np.bincount(_places(labels), minlength=PLACES)
        rows = total.reshape(-1, _ROW)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["row", "counts"])

    return run


def _places(labels: np.ndarray) -> np.ndarray:
    return (mix(labels) % np.uint64(PLACES)).astype(np.int64)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_ROW, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"row": group["row"].iloc[:1], "counts": [total.tobytes()]})


def _prefixes(known, k: int, similarity: float):
    """Each text's shingles that come first, the rarest, in one order of all: one at least is shared at the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, raw in slices(batch, "text"):
                labels, first = shingles(Words(off, LOWER[raw], ALNUM), k)
                n = np.diff(first)
                labels = labels[np.lexsort((labels, known.value[_places(labels)], np.repeat(np.arange(len(n)), n)))]
                most = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(most))), pa.int32()), pa.array(labels[gather(first[:-1], most)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), pa.array(n, pa.int64()), keys], names=["rep", "n", "keys"])

    return run


def _near(docs: DataFrame, last: DataFrame, *, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """pairs(a, b) of last(rep, label) in different groups, with every one whose alignment can reach the similarity."""
    texts = docs.join(F.broadcast(last) if last.count() <= BROADCAST_IDS else last, docs.doc == last.rep, "left_semi").select("doc", "text")
    counted = texts.mapInArrow(_frequencies(k), "row bigint, counts binary").groupBy("row").applyInPandas(_added, "row bigint, counts binary").collect()
    total = np.zeros((PLACES // _ROW, _ROW), np.int64)
    for r in counted:
        total[r.row] = np.frombuffer(r.counts, np.int64)
    known = docs.sparkSession.sparkContext.broadcast(total.ravel())
    # rows of one doc_id and text meet once only
    firsts = texts.mapInArrow(_prefixes(known, k, similarity), "rep bigint, n bigint, keys array<bigint>").distinct()
    keyed = stash(firsts.join(last, "rep").select("rep", "label", "n", F.posexplode("keys").alias("at", "key")).select("key", "rep", "label", "n", (F.col("n") - F.col("at")).alias("rest")), "prefixes")
    groups = keyed.groupBy("key", "label").agg(F.count("*").alias("members"))
    mixed = stash(groups.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("label", F.struct("members", "label")).alias("largest")).where("groups > 1").select("key", "largest"), "mixed")
    met = stash(keyed.join(mixed, "key"), "met")
    x = met.where("label <> largest").select("key", *(F.col(c).alias(f"{c}_x") for c in ("rep", "label", "n", "rest")))
    y = met.select("key", *(F.col(c).alias(f"{c}_y") for c in ("rep", "label", "n", "rest")), (F.col("label") == F.col("largest")).alias("in_largest"))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - F.lit(1e-9))
    # a pair outside the largest group is there twice: once is enough
    found = x.join(y, "key").where((F.col("in_largest") & (F.col("label_x") != F.col("label_y"))) | (~F.col("in_largest") & (F.col("label_x") < F.col("label_y"))))
    found = found.where((F.least("n_x", "n_y") >= need) & (F.least("rest_x", "rest_y") >= need))
    return found.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _content(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, raw in slices(batch, "text"):
                labels, first = shingles(Words(off, LOWER[raw], ALNUM), k)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), pa.array([labels[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["doc", "seq"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [aligned(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similarity) for x, y in zip(batch.column("seq_a"), batch.column("seq_b"))]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([x > 0 for x in got], pa.bool_()))

    return run


def links(docs: DataFrame, pairs: DataFrame, *, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs(a, b) of docs(doc, text) whose banded alignment reaches the similarity, with it."""
    ids = stash(pairs.select("a").union(pairs.select("b")).distinct(), "ids").withColumnRenamed("a", "id")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # rows of one doc_id may hold several texts: any one of them, but always the same, stands for it
    content = docs.join(wanted, docs.doc == wanted.id, "left_semi").mapInArrow(_content(k), "doc bigint, seq binary").groupBy("doc").agg(F.min("seq").alias("seq"))
    content = stash(content, "content")
    left = pairs.join(content.withColumnsRenamed({"doc": "a", "seq": "seq_a"}), "a")
    return left.join(content.withColumnsRenamed({"doc": "b", "seq": "seq_b"}), "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_verify(similarity), "a bigint, b bigint, similarity double")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, similarity: float = SIMILARITY, count: int = SKETCHES, least: int = PER_SKETCH, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """doc_id, rep_id (least doc_id of the same words), class_id (least doc_id of the group of near-duplicates)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    seen = stash(rows.mapInArrow(_sketched(k, count, least), "doc bigint, digest binary, sketch binary"), "sketches")
    reps = stash(seen.where("doc is not null and digest is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch")), "reps")
    joined = _groups(rows.where("doc is not null"), reps, depths, k=k, similarity=similarity)
    heads = reps.select("digest", "rep").join(joined, F.col("rep") == F.col("id")).select("digest", "rep", "label")
    # a null doc_id stays out of the join, so that its class is null
    own = seen.select(F.col("doc"), F.when(F.col("doc").isNotNull(), F.col("digest")).alias("digest"))
    return own.join(heads, "digest", "left").select(F.col("doc").alias(doc_id), F.coalesce("rep", "doc").alias("rep_id"), F.coalesce("label", "doc").alias("class_id"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without those that are not the first of their class; rows of one doc_id stay or go together."""
    gone = classes(docs, doc_id=doc_id, **options).where(f"`{doc_id}` <> class_id").select(F.col(doc_id).alias("gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
