"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.session import materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node on the least of them and itself. Edges are (u, v) with u > v.

    The least neighbour is found by a partial aggregate and joined back, so that a node with very many edges is
    split like any other skewed join key.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least id reachable, for every node of an edge between two different nodes."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "graph-edges")
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        up, down = F.count_if(F.col("up") == 1), F.count_if(F.col("up") == 0)
        if ends.groupBy("node").agg(up.alias("n_up"), down.alias("n_down")).where("n_up > 1 or n_up = 1 and n_down > 0").isEmpty():
            break  # every node hangs on a root
        now = materialize(_star(_star(now, True), False), "graph-edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
