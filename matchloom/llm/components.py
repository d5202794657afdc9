"""Connected components of an edge table by alternating large and small stars; nothing is collected.

Defined results: repeated edges count once; an edge from a node to itself, or with a null end, joins nothing; an empty
table gives an empty result; ties can't occur, as the least node is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step, on edges (u, v) with u > v."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # every u of large is greater than its v, or equal where u is its own least neighbour
    large = large.where("u <> v")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low, "u")
    return joined.select(F.col("u"), F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node that has an edge to another node in edges (u, v); root is the component's least node.

    Each round is written to the shared folder and replaces the one before. A vertex with very many neighbours meets
    one row of minima in a join that Spark can split; it never forms a list.
    """
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = materialise(now, "edges"), None
    for _ in range(rounds):
        after = materialise(_stars(now), "edges")
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in {f.rpartition("/")[0] for f in now.inputFiles()}:
            drop_path(spark, path)
        now = after
        if tuple(found) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state = tuple(found)
    raise RuntimeError(f"components have not settled in {rounds} rounds")
