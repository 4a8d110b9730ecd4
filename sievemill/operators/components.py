"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievemill.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of the component each node of an edge belongs to.

    Labels start at the smallest neighbour. Each round takes the smallest label among the neighbours and,
    from the third round on, the label of that label (pointer jumping), until no label changes: short
    chains end in a few cheap rounds, long ones in rounds that grow with the logarithm of their length.
    Minima are aggregated map-side, so a node with very many edges costs one row a partition; the lookups
    by label, where many nodes share one key, are split by adaptive execution. Each round is written to the
    shared checkpoint folder, so losing an executor repeats little. Loops and edges with a null end join
    nothing; repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    ways = F.explode_outer(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))  # one reading of the edges for both ways
    both = cut(pairs.select(ways.alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    rounds = 0
    while True:
        rounds += 1
        own = labels.select("node", "component", F.col("component").alias("old"))
        told = both.join(labels, both.u == labels.node).select(F.col("v").alias("node"), "component", F.lit(None).cast(labels.schema["component"].dataType).alias("old"))
        fresh = own.unionByName(told).groupBy("node").agg(F.min("component").alias("component"), F.min("old").alias("old"))
        if rounds > 2:
            roots = labels.select(F.col("node").alias("r"), F.col("component").alias("jump"))
            fresh = fresh.join(roots, F.col("component") == F.col("r"), "left").select("node", "old", F.least("component", "jump").alias("component"))
        moved = Observation()
        labels = cut(fresh.observe(moved, F.count_if(F.col("component") < F.col("old")).alias("n"))).select("node", "component")
        if not moved.get["n"]:
            return labels
