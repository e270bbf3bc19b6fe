"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examweft.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v); root is the smallest node that edges lead to.

    Each round hooks every node to its smallest smaller neighbour, follows these hooks to their ends by pointer
    jumping (joins of nodes, not of edges), and keeps the edges between different ends only, once each. A group of
    many edges is a few after one round. Rounds are written tables: both sides of each join are plain scans, which
    adaptive execution can split where one node has very many edges. An empty table gives none.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = materialize(down.distinct(), "edges")
    labels = None
    while labels is None or not down.isEmpty():
        hooks = materialize(down.groupBy("u").agg(F.min("v").alias("to")), "hooks")
        while True:
            above = hooks.select(F.col("u").alias("to"), F.col("to").alias("higher"))
            jumped = materialize(hooks.join(above, "to", "left").select("u", F.coalesce("higher", "to").alias("to"), F.col("higher").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("u", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            ends = down.select(F.col("v").alias("u")).distinct().join(hooks, "u", "left_anti")
            labels = materialize(hooks.unionByName(ends.withColumn("to", F.col("u"))).select(F.col("u").alias("node"), F.col("to").alias("root")), "labels")
        else:
            moved = hooks.select(F.col("u").alias("root"), "to")
            labels = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        # One end at a time, each pre-aggregated, so that repeated edges are one before the other end is looked up.
        half = down.join(hooks, "u").select(F.col("to").alias("u"), "v").where("u <> v").distinct()
        ends = hooks.select(F.col("u").alias("v"), F.col("to").alias("w"))
        both = half.join(ends, "v", "left").select("u", F.coalesce("w", "v").alias("v")).where("u <> v")
        down = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return labels
