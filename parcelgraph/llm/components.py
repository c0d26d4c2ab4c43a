"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.llm.shared import drop, written


#: Parts of a node with many edges in a join: no task gets all edges of the centre of a star.
SALTS = 8


def _beside(edges: DataFrame, least: DataFrame, key: str, by: str) -> DataFrame:
    """Joins each edge with its ``key``'s row of ``least``, edges of one key dealt out by the hash of ``by``."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the root is its component's least node.

    Large-star and small-star steps in turn, until nothing changes.  A round
    costs joins on the edges only, none of whose sides is collected; the number of
    rounds grows with the logarithm of the number of nodes.
    """
    edges = written(edges.select("a", "b").filter("a != b").distinct())
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _beside(both, least, "u", "v").filter("v > u").select("v", "m")  # v > m
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = _beside(large, low, "v", "m").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("least").alias("b")), F.struct(F.col("m").alias("a"), F.col("least").alias("b")))).alias("e"))
        old, edges = edges, written(small.select("e.a", "e.b").filter("a != b").distinct())
        drop(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
