"""Connected components of a graph held in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """Least node of each node's component: ``node, component``.

    ``edges (a, b)`` are undirected; edges with a null end are ignored, a loop
    makes its node a component of its own.  Large-star and small-star steps
    alternate until nothing changes, which takes rounds in the order of the
    logarithm of the number of nodes.  Each round is an aggregate and a join
    and ends in a checkpoint, so neither lineage nor a single task grows.
    """
    own = edges.select("a", "b").where("a is not null and b is not null")
    nodes = own.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = cut_lineage(
        own.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    )
    print_of = None
    while True:
        both = stars.union(stars.select("m", "v")).toDF("v", "u")
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("to"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", "to"), F.struct(F.col("m").alias("v"), "to"))).alias("e"))
            .select("e.v", F.col("e.to").alias("m"))
            .where("v <> m")
            .distinct()
        )
        stars = cut_lineage(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == print_of:
            break
        print_of = now
    root = stars.groupBy("v").agg(F.min("m").alias("m"))
    return nodes.join(root, nodes.node == root.v, "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )
