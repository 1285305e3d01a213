"""Connected components of a large graph by alternating large-star and small-star steps.

Each step needs only the smallest neighbour of a vertex (a partial aggregate) and an equi-join, so a vertex of many links
is never gathered in one task. Each round is staged; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged


ROWS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _smallest(directed: DataFrame) -> DataFrame:
    """For each a, the smallest of itself and its neighbours, next to each neighbour."""
    low = directed.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return directed.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) in any direction -> (id, component) for each linked id; component is the smallest id reached."""
    spark = links.sparkSession
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        found = _smallest(large)
        small = found.select(F.col("b").alias("a"), F.col("low").alias("b")).union(found.select("a", F.col("low").alias("b")))
        # Links never grow in number: a partition of ROWS of them keeps the rounds' files few.
        after_edges = staged(small.where("a <> b").distinct().coalesce(-(-before[0] // ROWS)), "links")
        after = _state(after_edges)
        discard(spark, edges)
        edges = after_edges
        if after == before:
            break
        before = after
    low = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = low.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return low.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.parent, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.parent[y] = x
        self.size[x] += self.size[y]
        return True


def spanning_links(n: int, linked, first: int) -> list[tuple[int, int]]:
    """Links that connect what the relation connects, without listing all pairs.

    linked(x) gives the members linked to x. The first member's links are taken, then those of every member outside the
    largest component: of any two members, one is asked or both are already connected.
    """
    forest, found = Forest(n), []
    asked = np.zeros(n, bool)

    def ask(x: int) -> None:
        asked[x] = True
        for y in linked(x):
            if forest.join(x, int(y)):
                found.append((x, int(y)))

    ask(first)
    for x in range(n):
        root = forest.find(x)
        if not asked[x] and 2 * forest.size[root] <= n:
            ask(x)
    return found
