"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatsheet.llm import common

#: Edges for each file that is written; there are no more edges than links, and no round has
#: more than the one before.
FILE_EDGES = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _files(edges: int) -> int:
    return -(-edges // FILE_EDGES)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node of ``links`` (a, b)
    that is not itself a root. Links of a node to itself and repeated links are allowed.
    ``links`` is read twice and should be stored.

    Every round writes its edges to the shared folder; the rounds end when the edges stay
    the same, after a number of them that follows the logarithm of the longest chain.
    """
    edges = common.written(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
        files=_files(links.count()),
    )
    before = _print(edges)
    while before[0]:
        after_large = _large_star(edges)
        moved = common.written(_small_star(after_large), "edges", files=_files(before[0]))
        now = _print(moved)
        common.forget(edges)
        edges = moved
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
