"""Connected components of a graph given by edges, by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of an edge with the smallest id it is connected to.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of them. The groups are
    summed up by a minimum, which combines before the shuffle, written, and joined back, which adaptive execution can
    split: a node of any degree fits. Rounds go on until all are stars; each lowers a label or settles, so they end.
    Self-loops and repeated edges are harmless, null ends are dropped, an empty table gives none. Each round's tables
    are in the shared folder.
    """
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = materialize(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct())
        least = materialize(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(least.select(F.col("m").alias("u"), "v")).distinct()
        edges = materialize(small)
        # Done when all are stars: every leaf has one centre, which is no leaf.
        if least.where("n > 1").isEmpty() and edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
