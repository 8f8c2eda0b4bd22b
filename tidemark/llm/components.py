"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share a root.

    In each round every node joins the neighbour with the smallest hash, which is drawn
    anew each round, and edges are rewritten to the chosen nodes.  Only minima are
    aggregated, so a node of any degree is combined before the shuffle, and the edge table
    shrinks by a constant factor in expectation.  Both tables are written each round.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    mapping = materialize(nodes.withColumn("root", F.col("node")), "roots")
    for turn in range(max_rounds):
        if edges.isEmpty():
            return mapping
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = chosen.select(F.col("a").alias("root"), F.when(rank("a") < F.col("m"), F.col("a")).otherwise(F.col("m.id")).alias("to"))
        step = materialize(step, "step")
        left, right = (step.select(F.col("root").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        mapping = materialize(mapping.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = edges.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "edges")
    raise RuntimeError("the edge table did not contract")
