"""Connected components of a link table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relkit.llm._text import discard, stash


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each end of links(a, b): the least id that can be reached.

    Each round is two joins and a grouped minimum of tables as long as the links; the
    number of rounds grows with the logarithm of the longest chain.  A vertex with very
    many links is a skewed join key at most, and its messages are pre-aggregated.
    """
    both = stash(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    before = labels
    while True:
        told = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("told"))
        near = labels.join(told, labels.id == told.a, "left").select("id", F.col("label").alias("was"), F.least("label", "told").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("label").alias("up"))
        new = stash(near.join(up, "to", "left").select("id", "was", F.least("to", "up").alias("label")), "labels")
        discard(before)
        before, labels = new, new.select("id", "label")
        if new.where("label < was").isEmpty():
            discard(both)
            return labels
