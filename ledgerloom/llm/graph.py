"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.joins import spread_join
from ledgerloom.session import written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        spread_join(both.where("v > u"), least, ["u"], total=n)
        .select(F.greatest("v", F.least("u", "m")).alias("u"), F.least("u", "m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every smaller neighbour of a node, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        spread_join(edges, least, ["u"], total=n)
        .select("u", "v", "m")
        .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, root)``: root is the least node reachable.

    Any orderable type of node. Null ends and self links are ignored; nodes
    without a link have no row. Large-star and small-star steps alternate until
    the edge set stays the same; every round is written to the shared folder.
    Neither step gathers a neighbourhood: both are an aggregate and a join that
    deals the links of hubs over tasks.
    """
    oriented = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current, before = written(oriented, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        current = written(_small_star(_large_star(current, state[0]), state[0]), "edges")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select(F.col("v"), F.col("v")).distinct())
