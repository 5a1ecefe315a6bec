"""Connected components of a graph given by its edges, in rounds of large and small stars.

A round replaces edges by edges to the smallest known neighbour. All steps are aggregations with
map-side minima and joins that adaptive execution can split, so neither a node with very many
neighbours nor a long chain meets in one task. Each round is written to the shared folder; its
shuffle files and the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import drop_written, free_shuffles, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge (a, b) reaches.

    Edges with a null end or both ends equal say nothing and are left out, repeated edges count
    once. No edges give an empty table.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        last, now = now, written(small, "edges")
        drop_written(last)
        free_shuffles(now.sparkSession)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
