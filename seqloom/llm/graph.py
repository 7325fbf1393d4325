"""Connected components of an edge table by alternating stars, in rounds whose lineage is cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b, both long); root is the smallest node of its component.

    Loops and repeated edges are allowed; an empty table gives an empty result. Each round joins every node with the least of
    its neighbours (an aggregate, so a node with many neighbours is combined in the map and split by the skew join). Joins are
    merged whatever size Spark expects, so no table of nodes passes through the driver.
    """
    shared_dir(edges.sparkSession)
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        links = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct().checkpoint()
        state = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(pmod(xxhash64(v, u), 1000003))").alias("s")).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
