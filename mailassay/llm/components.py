"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailassay.session import stage_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every greater neighbour of a node on the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u with a link: v is the smallest node reachable from u.

    Alternates the two star steps until nothing moves; the number of rounds grows
    with the logarithm of the component size, and each round holds at most one
    link per node and neighbour. Every round is a written table, so a lost
    executor costs one round at most.
    """
    edges = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u <> v").distinct()
    edges = stage_table(edges, "links")
    before = None
    while True:
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return edges.filter("u <> v")
        before = state
        # small stars first: what comes from within shards is stars already
        edges = stage_table(_large_star(stage_table(_small_star(edges), "links")), "links")
