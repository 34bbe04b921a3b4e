"""Connected components of a graph by alternating stars: each round joins edges with minima over neighbours, and is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, workspace, written


def _large(edges: DataFrame, path: str) -> DataFrame:
    """Each node gives its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), path)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, path: str) -> DataFrame:
    """Each node gives its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), path)
    given = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return given.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for each node of edges (a, b: long) but the roots.

    The number of rounds grows with the logarithm of the longest path. Edges of a node to itself are passed over. Minima are written
    before edges are joined with them: the join then stands on exchanges of its own, and a node with very many edges is split.
    """
    at, n = workspace(edges.sparkSession, "components"), 0
    now = written(edges.select("a", "b").where("a <> b").distinct(), f"{at}/0")
    state = None
    while True:
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == state or not after[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, n = after, n + 1
        large = written(_large(now, f"{at}/{n}-a"), f"{at}/{n}-large")
        now = written(_small(large, f"{at}/{n}-b"), f"{at}/{n}")
        for done in (f"{n - 1}", f"{n}-a", f"{n}-b", f"{n}-large"):
            delete(edges.sparkSession, f"{at}/{done}")
