"""Connected components by alternating stars: every round is joins and partial aggregates over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import discard, freed, joined, written


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with m, the least v of their u; ``total`` or fewer. The edges of a node that has very many are not dealt
    by node: they get its least by broadcast."""
    return joined(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them. ``edges`` go from the greater node."""
    tied = _with_least(edges, total)
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.where("v = m").select("u", "v"))


def _open(edges: DataFrame) -> bool:
    """Whether a node still has two edges down, or one down and one up: then the edges are no stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return bool(ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0").head(1))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its least node.

    A star's edges stay where they are if its centre is hot: only least values and counts of each node are dealt by node.
    No edges give no rows; loops and repeated edges are ignored.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while _open(now):
        total = now.count()
        large = written(_large_star(now, total).distinct(), label)
        before, now = now, written(_small_star(large, total).distinct(), label)
        discard(before)
        discard(large)
        freed(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
