"""Connected components of an edge list, and graph helpers on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_table


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """(node, component) of each node of the undirected edges; the component is its smallest node.

    Alternating large-star and small-star steps: each joins neighbours to smaller neighbours by aggregation, so the
    rounds grow with the logarithm of a component's diameter, and a hub's edges are combined before the shuffle. Null
    ends and loops of one node are handled (a loop names a node); an empty list gives no row.
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    links = cut_table(raw.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        smallest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        fresh = cut_table(small)
        same = fresh.count() == links.count() and fresh.join(links, ["u", "v"], "left_anti").isEmpty()
        links = fresh
        if same:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
