"""Line dedup: repeated runs of lines, from a suffix array over line-ID sequences by prefix doubling.

Each document is a sequence of line IDs (its lines that are not blank).

1. `doubling`: the suffixes of all sequences are ranked by their first line, then by their
   first 2, 4, ... lines, until no two agree: in a round, a suffix's new key is its rank and
   the rank of the suffix h lines on.  The suffixes of one rank are an interval of the suffix
   array in which the longest common prefix (LCP) is at least that many lines.
2. `longest`: from the widest of these intervals down, each suffix is taken into intervals of
   longer prefixes: what of its first n lines it has in common with an earlier suffix, and
   of the next 2**k lines with one of the same interval, makes n + 2**k.  In the end, each
   suffix knows the LCP interval that it shares with an earlier suffix, by its exact length
   and its earliest member.
3. `runs`: of these, the ones that no other of the document holds are its maximal repeated
   runs.  Each is a later copy of the run at its interval's earliest member, and is deleted,
   if it has MIN_LINES lines; of a shorter one, the lines of MIN_WORDS words or more are
   (none where min_words is None).

Scale: suffixes whose first line occurs once are out before the first round, those whose
class has one member after each, so a round is as long as what repeats at its length.
The number of rounds is the logarithm of the longest repeat.  The first member of a class is
pre-aggregated with its rank and joined back, so a line that a third of all documents hold
is a skewed join key, which Spark splits.  Ranks come from a range-partitioned sort of the
distinct keys, not of the suffixes.  Looking h lines on is a window over one document.  Each
round is written to the shared folder and deleted when it has been read for the last time.
A text is shuffled once, by its document.

Edge cases: a null text stays null and has no lines; blank lines are kept and are not
part of any sequence; a document with a null doc_id has no order, so it is left as it is
and is no source; repeated rows (same doc_id and text) count as one document and are kept
or cut alike; extra columns are kept by `dedup`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relkit.llm._text import discard, stash

MIN_LINES = 2
#: A repeated line of so many words is deleted even if no line next to it repeats.
MIN_WORDS = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """suffixes(doc, pos, *keys) of classes with two members at least: their rank by the keys, and their class's first member."""
    classes = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")).where("n > 1").drop("n")
    # ids that rise along a sorted table are ranks; written before use, as they hang on the partitions
    ranks = stash(classes.orderBy(*keys).withColumn("new", F.monotonically_increasing_id()), "line-ranks")
    out = stash(suffixes.join(ranks, keys).select("doc", "pos", F.col("new").alias("rank"), "first"), "line-suffixes")
    discard(ranks)
    return out


def _ahead(suffixes: DataFrame, lines: int) -> DataFrame:
    """suffixes that have a ranked suffix so many lines on, with its rank as `then`."""
    there = Window.partitionBy("doc").orderBy("pos").rangeBetween(lines, lines)
    return suffixes.withColumn("then", F.max("rank").over(there)).where("then is not null").select("doc", "pos", "rank", "then")


def doubling(docs: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: (doc, pos, rank, first) of the suffixes of docs(doc, text) that agree in so many with another."""
    lines = F.expr("filter(split(text, '\\n', -1), l -> trim(l) <> '')")
    suffixes = docs.where("doc is not null").select("doc", F.posexplode(F.transform(lines, lambda x: F.unhex(F.md5(x)))).alias("pos", "line")).distinct()
    out = [_ranked(suffixes, ["line"])]
    while True:
        more = _ranked(_ahead(out[-1], 1 << (len(out) - 1)), ["rank", "then"])
        if more.isEmpty():
            discard(more)
            return out
        out.append(more)


def longest(levels: list[DataFrame]) -> DataFrame:
    """(doc, pos, length, first) of the suffixes that repeat an earlier one: the longest prefix that does, and its first occurrence."""
    now = None
    for k in range(len(levels) - 1, -1, -1):
        later = levels[k].where("struct(doc, pos) <> first").select("doc", "pos", F.lit(1 << k).alias("length"), "first")
        if now is None:
            new = stash(later, "line-longest")
        else:
            # members of an interval: those that are in it so far, and the earliest one that they all repeat
            sources = now.select("first.doc", "first.pos", "length", "first").distinct()
            members = now.withColumn("open", F.lit(True)).union(sources.withColumn("open", F.lit(False)))
            ranks = levels[k].select(F.col("doc").alias("d"), F.col("pos").alias("p"), "rank")
            on = (members.doc == ranks.d) & (members.pos + members.length == ranks.p)
            seen = stash(members.join(ranks, on, "left").where("open or rank is not null").select("doc", "pos", "length", "first", "open", "rank"), "line-members")
            inner = seen.where("rank is not null").groupBy("first", "length", "rank").agg(F.min(F.struct("doc", "pos")).alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
            inner = stash(inner, "line-intervals")
            moved = seen.where("open").join(inner, ["first", "length", "rank"], "left")
            on = F.expr("to is not null and to <> struct(doc, pos)")
            moved = moved.select("doc", "pos", F.when(on, F.col("length") + (1 << k)).otherwise(F.col("length")).alias("length"), F.when(on, F.col("to")).otherwise(F.col("first")).alias("first"))
            new = stash(moved.union(later.join(now.select("doc", "pos"), ["doc", "pos"], "left_anti")), "line-longest")
            discard(now, seen, inner)
        now = new
        discard(levels[k])
    return now


def runs(docs: DataFrame) -> DataFrame:
    """(doc, pos, length, first) of the maximal repeated runs of docs(doc, text); positions count lines that are not blank."""
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("pos") + F.col("length")).over(before), F.lit(0))
    return longest(doubling(docs)).withColumn("reach", reach).where("pos + length > reach").drop("reach")


def _cut(min_lines: int, min_words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            said = batch.column("row").field("text")
            for text, copies in zip(said, batch.column("copies")):
                text, n, gone = text.as_py(), 0, 0
                if text is not None:
                    lines = text.split("\n")
                    own = [i for i, x in enumerate(lines) if x.strip(" ")]
                    n = len(own)
                    if copies.is_valid:
                        cut = set()
                        for r in copies.as_py():
                            run = own[r["pos"] : r["pos"] + r["length"]]
                            cut.update(run if r["length"] >= min_lines else (i for i in run if min_words is not None and len(_WORD.findall(lines[i])) >= min_words))
                        gone = len(cut)
                        text = "\n".join(x for i, x in enumerate(lines) if i not in cut)
                texts.append(text)
                counts.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("row").field("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["row", "kept", "n_lines", "n_removed"])

    return run


def cut(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """row (all columns of docs but the text), kept (the text without later copies), n_lines (not blank) and n_removed."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 at least")
    rest = [c for c in docs.columns if c != text]
    whole = F.struct(*(F.col(f"`{c}`") for c in rest))
    rows = docs.select(F.struct(whole.alias("row"), F.col(text).alias("text")).alias("row"), F.col(doc_id).cast("bigint").alias("doc"))
    copies = runs(rows.select("doc", "row.text")).groupBy("doc").agg(F.collect_list(F.struct("pos", "length")).alias("copies"))
    out = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in rest])), *T.StructType().add("kept", "string").add("n_lines", "long").add("n_removed", "long").fields])
    return rows.join(copies, "doc", "left").select("row", "copies").mapInArrow(_cut(min_lines, min_words), out)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs cut out of `text`; rows of which no line is left go."""
    found = cut(docs, doc_id=doc_id, text=text, min_lines=min_lines, min_words=min_words).where("n_removed = 0 or n_removed < n_lines")
    return found.select(*(F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM l WHERE trim(line) <> ''),
w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM o),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS nth FROM w WHERE next IS NOT NULL),
s AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM o),
g AS (SELECT doc_id, unnest([pos, pos + 1]) AS pos FROM f WHERE nth > 1 UNION SELECT doc_id, pos FROM s WHERE nth > 1 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
r AS (SELECT doc_id, ln FROM o JOIN g USING (doc_id, pos)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM l ANTI JOIN r USING (doc_id, ln) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id), m AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
