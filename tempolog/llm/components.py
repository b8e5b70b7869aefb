"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempolog.llm.common import durable


def connected_components(links: DataFrame) -> DataFrame:
    """The smallest node of each node's component, as ``(node, root)``, for nodes that are not their own root.

    ``links`` has two long columns, ``a`` and ``b``. Large-star and small-star steps alternate until the links are
    stars: each step moves every link towards the smallest known neighbour, so that the number of rounds grows with
    the logarithm of the longest path. A node's links are only ever reduced to their minimum (with partial
    aggregation), never gathered. Null and self links are ignored. Each round is written to the shared folder.
    """
    links = durable(_larger_first(links.where("a is not null and b is not null")))
    state = _state(links)
    while state[0]:
        links = durable(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if before == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _larger_first(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of the neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _larger_first(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _larger_first(moved.union(least.select("a", "m")))


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum over their hashes, which change when any link does."""
    mixed = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(links.agg(F.count("*"), F.sum(mixed)).first())
