"""Connected components of an undirected graph given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift import scratch
from logsift.scratch import hot_keys, join_counted, join_dealt, materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) for every node, root = smallest id of its component.

    ``nodes``: written table (id); ``edges``: table (u, v), one direction is enough.
    Every round each node looks at its grandparent and at those of its neighbours, and the
    smallest goes to the node and to its parent (FastSV: Zhang, Azad, Hu 2020), so a path
    of n nodes needs about log n rounds. The edges never turn into stars. Keys that can be
    hot, a node of high degree and a parent with many children, are dealt out by count.
    """
    loose = edges.where("u <> v")
    both_ways = materialize(
        loose.select("u", "v").union(loose.select("v", "u")).distinct().withColumnRenamed("v", "id"),
        "edges",
    )
    degrees = hot_degrees = None
    crowded = nodes.count() > scratch.HOT_KEY_ROWS  # with fewer nodes no key can be hot
    if crowded:
        degrees = materialize(both_ways.groupBy("id").agg(F.count("*").alias("_rows")), "degrees")
        hot_degrees = hot_keys(degrees, ["id"], "_rows")

    parents = nodes.select("id", F.col("id").alias("p"))
    hopped = parents.withColumn("g", F.col("p"))
    while True:
        seen = hopped.select("id", F.col("g").alias("seen"))
        if hot_degrees is not None:
            met = join_dealt(both_ways, seen.join(degrees, "id"), ["id"], "_rows", hot_degrees)
        else:
            met = both_ways.join(seen, "id")
        better = (
            met.groupBy("u")
            .agg(F.min("seen").alias("seen"))
            .join(hopped.withColumnRenamed("id", "u"), "u")
            .where(F.col("seen") < F.col("g"))
        )
        offers = (
            hopped.select("id", F.col("g").alias("c"))
            .union(better.select("u", "seen"))
            .union(better.select("p", "seen"))
        )
        smallest = offers.groupBy("id").agg(F.min("c").alias("c"))
        step = materialize(
            smallest.join(parents, "id").select(
                "id", F.col("c").alias("p"), (F.col("c") < F.col("p")).alias("moved")
            ),
            "components",
        )
        parents = step.select("id", "p")
        if step.where("moved").isEmpty():
            return parents.withColumnRenamed("p", "root")
        above = parents.select(F.col("id").alias("p"), F.col("p").alias("g"))
        if crowded:
            children = parents.groupBy("p").agg(F.count("*").alias("_rows"))
            hopped = join_counted(
                parents, materialize(above.join(children, "p"), "parents"), ["p"], "_rows"
            )
        else:
            hopped = parents.join(above, "p")
        hopped = hopped.select("id", "p", "g")
