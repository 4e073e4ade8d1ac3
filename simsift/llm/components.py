"""Connected components: in memory for the links a task has found, and over a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, temporary


class Forest:
    """Disjoint sets over 0..n-1; the smallest member names a set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            above = self.up[r]
            if np.array_equal(above, r):
                break
            r = above
        self.up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A link from every member that isn't its set's name to that name: one for each, however many were joined."""
        every = np.arange(len(self.up))
        roots = self.root(every)
        apart = roots != every
        return every[apart], roots[apart]


def _stars(edges: DataFrame) -> bool:
    """No node of links (a, b), a > b, has two links down, or links both down and up: then b is the label of a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of all nodes in links (a, b): the label is the smallest node that can be reached.

    Alternates large-star and small-star: in each, nodes link to the smallest of their neighbourhood, so
    the number of links never grows and falls to one per node in a number of rounds that is logarithmic
    in practice. Minima are partial aggregates; a node with very many links is split by the skew join.
    The rounds end as soon as the links are stars, which one aggregate tells without a further round.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(pairs, name)
    while not _stars(edges):
        with temporary(edges.sparkSession) as kept:
            both = edges.union(edges.select("b", "a")).toDF("u", "v")
            # minima are read back, so that the joins are of plain exchanges, which Spark can split at a hot node
            least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = stored(large, name)
            least = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
            small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            edges = kept(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), name)
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b"), F.col("b")).distinct())
