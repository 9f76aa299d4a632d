"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def connected_components(edges: DataFrame, a: str, b: str, *, node: str = "node", root: str = "root") -> DataFrame:
    """The smallest node of each node's component, for all nodes of the edges.

    Large-star and small-star rounds (Kiveris and others, 2014): each hangs a node's neighbours on the smallest of
    them, until nothing moves, after a number of rounds that grows with the logarithm of the largest component. Each
    round is an aggregate and a join over the edges; both sides of the join are tables of their own, so Spark splits a
    node with very many neighbours. Nothing but a count and a checksum reaches the driver.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = settle(links.where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _hang(both, F.col("v") > F.col("u"))
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = settle(_hang(down, F.lit(True), own=True).distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    hung = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = hung.select("v").distinct().select(F.col("v").alias(node), F.col("v").alias(root))
    return settle(hung.select(F.col("u").alias(node), F.col("v").alias(root)).unionByName(roots))


def _hang(pairs: DataFrame, which, *, own: bool = False) -> DataFrame:
    """Hang the neighbours chosen by ``which`` on the smallest neighbour of each node, the node itself included."""
    pairs = settle(pairs)
    least = settle(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w"))
    hung = pairs.where(which).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        hung = hung.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()
