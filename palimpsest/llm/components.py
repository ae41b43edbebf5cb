"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.store import written


def _stars(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges beside the smallest neighbour of `node`; the minima are a table, so that a hot node's edges can be split."""
    least = written(edges.groupBy(node).agg(F.min(other).alias("least")), "least")
    return edges.join(least, node)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Links may repeat, run either way or join a node to itself; an empty table gives an empty
    one. The rounds end by themselves: each lowers the sum of the neighbours, and their number
    grows with the logarithm of the longest chain. Nothing is collected but a count per round.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a > b").distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_stars(both, "a", "b").where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct())
        large = written(large, "large")
        small = _stars(large, "a", "b").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("link")).select("link.*")
        now = written(small.where("a > b").distinct(), "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if mark == state:
            break
        mark = state
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
