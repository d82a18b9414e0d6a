"""Connected components of an edge table, without bringing edges or labels to the driver.

Each round every root with a smaller neighbouring root hooks to the least of
them, chains of hooks are shortened by pointer jumping, and the edges are
rewritten to roots and made distinct. At least half of the roots that still
have edges go in a round, so the rounds are logarithmic. Every intermediate
table is written to the shared folder; joins read written tables on both sides,
so that adaptive execution can split a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node of its component."""
    edges = scratch.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = scratch.written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not edges.isEmpty():
        hooks = scratch.written(edges.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("to")), "hooks")
        while True:
            longer = hooks.join(hooks.select(F.col("of").alias("to"), F.col("to").alias("next")), "to", "left").select("of", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))
            longer = scratch.written(longer, "hooks")
            hooks = longer.select("of", "to")
            if longer.where("moved").isEmpty():
                break
        at = lambda name: hooks.select(F.col("of").alias(name), F.col("to").alias(f"{name}_to"))
        moved = edges.join(at("a"), "a", "left").select(F.coalesce("a_to", "a").alias("a"), "b")
        moved = scratch.written(moved, "moved").join(at("b"), "b", "left").select("a", F.coalesce("b_to", "b").alias("b"))
        edges = scratch.written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        nodes = scratch.written(nodes.join(at("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), "nodes")
    return nodes
