"""Connected components of a graph of links, by alternating star contraction.

Each round every node points its larger (then its smaller) neighbours at the smallest node it knows, which
halves paths; rounds end when the edges stay the same. Every round is a written table on shared storage. The
smallest neighbour is an aggregate and the join that hands it on is an inner join which adaptive execution may
split, so a node with very many links is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.storage import staged


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    onward = edges.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b bigint) that reach a smaller one: the smallest reachable.

    Nodes that are the smallest of their component are left out."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    before = checksum(edges)
    while before[0]:
        edges = staged(small_star(large_star(edges).distinct()).distinct(), "stars")
        after = checksum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
