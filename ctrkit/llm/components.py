"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.session import shared_root


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), v < u. Large: every larger neighbour of a node links to the
    least neighbour; small: every smaller neighbour does, and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(least.select("u", F.col("m").alias("v"))))
    return linked.where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node reachable, for every node that has an edge.

    ``edges`` has long columns u and v in any order, repeats allowed. Nodes without an edge
    are not returned; an empty table gives an empty one. Rounds go on until the set of edges
    stays the same; each is cut from its lineage in the shared checkpoint folder. Aggregates
    and joins only: no neighbour list is ever gathered.
    """
    shared_root(edges.sparkSession)
    now = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
           .where("u <> v").distinct().checkpoint())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = _stars(_stars(now, large=True), large=False).checkpoint()
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
            .distinct())
