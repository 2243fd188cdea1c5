"""Connected components by alternating large and small stars over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Stars double the reach of each round; 2**30 links in a chain need fewer.
ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours (the larger ones, or the smaller ones and itself) to the least of them all."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = edges.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): every node of a link with the smallest id of its component.

    ``links`` has longs a, b; their order and repeats do not matter, links to itself and null ends
    are left out. Each round is written to the shared folder, so lineage stays short.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = written(_star(_star(edges, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
