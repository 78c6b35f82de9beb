"""Language identification by nearest centroid: TF-IDF n-gram vectors against several centroids a language.

A text is lower-cased, every run of non-letters becomes one space, and its byte n-grams
(1 to 3) are counted in DIM hashed places; a vector is log(1 + count) times IDF, of
length 1.  Each language has CLUSTERS centroids from spherical k-means on its training
texts.  The prediction is the language of the centroid of greatest cosine, the score
that cosine.  A text is *rejected* if it is further from that centroid than its radius:
its cosine is under REACH times what all but FAR of the language's training excerpts of
that length reach.  Lengths go by powers of two of the letters' bytes, since a short text
shares few n-grams with any centroid; excerpts of all lengths are cut from the training
texts, so that short texts have a radius of their own.

Training sees text and lang of labelled rows outside the held-out fold (crc32 of the
doc_id mod 5 = 0) only.  It takes a sample of about PER_LANG distinct texts a language, of
MOST_CHARS at most, picked by the hash of the text, so its cost and its bytes are bounded:
centroids are languages x CLUSTERS x DIM floats, which is what is broadcast.

Scale: a count by language (two columns), one filtered read for the sample, and one scan
for the predictions without a shuffle.

Edge cases: a null text or one without letters is `und` with score 0, and rejected; so
is every text if there are no labelled rows.  A null doc_id is not held out and not
trained on.  Rows of one doc_id or one text count once in the sample.  Repeated rows get the same result; extra columns are ignored by `predict`
and kept by `keep`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.llm._text import slices, stash

DIM = 1 << 13
CLUSTERS = 3
#: About so many training rows a language.
PER_LANG = 1500
#: Rejected below this share of the cosine that all but FAR of the training excerpts of a length reach.
REACH, FAR = 0.6, 0.01
#: Lengths, by powers of two of the letters' bytes; excerpts that a length needs to have its own quantile.
BANDS, LEAST_EXCERPTS = 14, 50
#: Longest text that is trained on.
MOST_CHARS = 1 << 16
#: More languages than this are an error: it bounds what is broadcast (about 100 KB a language).
MOST_LANGS = 1000
_ROWS = 512
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def counts(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """texts x DIM n-gram counts of lower-case UTF-8."""
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    where = np.concatenate(([0], np.cumsum(keep)))[offsets]
    data = np.where(letter, raw, 0x20)[keep].astype(np.uint32)
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(where))
    out = np.zeros(n * DIM, np.float32)
    grams = data
    for size in (1, 2, 3):
        if len(data) < size:
            break
        if size > 1:
            grams = (grams[:-1] << np.uint32(8)) | data[size - 1 :]
        place = ((grams + np.uint32(size << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        whole = of[: len(grams)] == of[size - 1 :]
        out += np.bincount((of[: len(grams)] * DIM + place)[whole], minlength=n * DIM)
    return out.reshape(n, DIM)


def _lower(batch: pa.RecordBatch, most_rows: int = _ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As `slices`, of lower-case texts and at most so many rows."""
    for at in range(0, batch.num_rows, most_rows):
        part = batch.slice(at, most_rows)
        texts = pc.utf8_lower(pc.fill_null(part.column("text").cast(pa.large_string()), ""))
        for lo, hi, off, raw in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            yield at + lo, at + hi, off, raw


def bands(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The length of each text, as the power of two of its letters' bytes."""
    letters = np.diff(np.concatenate(([0], np.cumsum(_LETTER[raw])))[offsets])
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), BANDS - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(found) * idf)


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by spherical k-means from farthest-first starts."""
    picked = [_unit(x.mean(0, keepdims=True))[0]]
    near = x @ picked[0]
    for _ in range(min(k, len(x)) - 1):
        picked.append(x[int(near.argmin())])
        near = np.maximum(near, x @ picked[-1])
    centres = np.stack(picked)
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        centres = np.stack([_unit(x[of == j].mean(0, keepdims=True))[0] if (of == j).any() else centres[j] for j in range(len(centres))])
    # a cluster of a stray text or two is none of the language's
    size = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    return centres[size >= min(size.max(), max(3, len(x) / 100))]


def excerpts(texts: list[str]) -> Iterator[list[str]]:
    """The texts, and from each one excerpt of every length of 4, 8, ... characters that it has."""
    yield texts
    for n in (1 << b for b in range(2, BANDS)):
        yield [t[at : at + n] for t in texts if len(t) > n for at in [zlib.crc32(t.encode()) % (len(t) - n)]]


def radii(texts: list[str], centres: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """By length: the cosine below which a text is too far from the language's nearest centroid; NaN where excerpts are too few."""
    lengths, cosines = [], []
    for part in excerpts(texts):
        for _, _, off, raw in _lower(pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["text"])):
            lengths.append(bands(off, raw))
            cosines.append((vectors(counts(off, raw), idf) @ centres.T).max(1))
    length, cosine = np.concatenate(lengths), np.concatenate(cosines)
    parts = [cosine[length == b] for b in range(BANDS)]
    return np.array([REACH * np.quantile(x, FAR) if len(x) >= LEAST_EXCERPTS else np.nan for x in parts])


def filled(radius: np.ndarray) -> np.ndarray:
    """languages x lengths without gaps: the least of the other languages, or else what the next shorter length has."""
    least = np.where(np.isnan(radius), np.inf, radius).min(0)
    out = np.where(np.isnan(radius), least, radius)
    for b in range(radius.shape[1]):
        if np.isinf(least[b]):
            out[:, b] = out[:, b - 1] if b else 0.0
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, texts = np.zeros(DIM), 0
    for batch in batches:
        for lo, hi, off, raw in _lower(batch):
            total += (counts(off, raw) > 0).sum(0)
            texts += hi - lo
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate(([texts], total)))], names=["place", "n"])


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> dict | None:
    """The model from docs(doc_id, text, lang), or None without labelled rows."""
    rows = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "lang", "text")
    share = stash(rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), per_lang / F.col("count")).alias("share")), "langid-share")
    if share.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: is lang the right column?")
    picked = rows.join(F.broadcast(share), "lang").where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).where((F.length("text") <= MOST_CHARS) & F.col("text").rlike(r"\p{L}"))
    sample = stash(picked.select("lang", "text").distinct(), "langid-sample")
    seen = {r.place: r.n for r in sample.select("text").mapInArrow(_frequencies, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    if not seen.get(-1):
        return None
    idf = np.log((1 + seen[-1]) / (1 + np.array([seen[i] for i in range(DIM)]))).astype(np.float32) + np.float32(1)
    known = docs.sparkSession.sparkContext.broadcast(idf)

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        centres = cluster(np.concatenate([vectors(counts(off, raw), known.value) for _, _, off, raw in _lower(batch)]), clusters)
        radius = radii(texts, centres, known.value).tolist()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "radius": [radius] * len(centres)})

    found = sample.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, radius array<double>").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.centre)))
    return {"idf": idf, "langs": np.array([r.lang for r in found]), "centres": np.stack([np.frombuffer(r.centre, np.float32) for r in found]), "radius": filled(np.array([r.radius for r in found], float))}


def nearest(model: dict, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each text, its cosine, and whether it is too far."""
    cosine = vectors(counts(offsets, raw), model["idf"]) @ model["centres"].T
    best = cosine.argmax(1)
    score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
    return best, score, score < model["radius"][best, bands(offsets, raw)]


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(doc, text) to (doc, lang_pred, score, rejected)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            langs, scores, rejected = [np.full(0, "")], [np.zeros(0)], [np.zeros(0, bool)]
            for lo, hi, off, raw in _lower(batch):
                some = letters[lo:hi]
                if m is None:
                    best, score, far, some = np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool), np.zeros(hi - lo, bool)
                else:
                    best, score, far = nearest(m, off, raw)
                langs.append(np.where(some, m["langs"][best] if m else "und", "und"))
                scores.append(np.where(some, score, 0.0))
                rejected.append(~some | far)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.concatenate(langs).tolist(), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], names=["doc", "lang_pred", "score", "rejected"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs without the rows that are rejected, by a scan: the decision travels with its row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            good = letters.copy()
            for lo, hi, off, raw in _lower(pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])) if m else ():
                good[lo:hi] &= ~nearest(m, off, raw)[2]
            yield batch.filter(pa.array(good & (m is not None)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select(F.col("doc_id").alias("doc"), "text"), fit(docs))
    return found.select(F.col("doc").alias("doc_id"), F.coalesce(fold(F.col("doc")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
