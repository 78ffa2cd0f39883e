"""Connected components of an edge table by alternating stars.

Every step is a grouped minimum with partial combining and a shuffle join, so a
node with a third of all edges is combined before it is shuffled.  The edges of
each round are written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrel.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` -> ``(node, label)``: label is the smallest node of its component;
    nodes without an edge are not listed."""
    state = written(edges.where("a <> b").distinct(), "edges")
    mark = None
    while True:
        state = written(_small_star(_large_star(state).distinct()).distinct(), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
