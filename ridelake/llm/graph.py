"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.plans.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; ``root`` is one node of its component, the same for all.

    Rounds of contraction: each node points to its least neighbour, or to itself; pointers are doubled until all end
    at a node that points to itself; links are renamed by them, and loops and repeats go. Of the nodes that still have links at
    least half disappear in a round. Minima are combined before the shuffle and both sides of each join are
    tables of their own, so a node with very many links is split. Links with a null end are left out.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = cut(edges)
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("to")
        ))
        while True:
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("end"))
            step = cut(step.join(onward, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            if step.where("moved").isEmpty():
                break
            step = step.drop("moved")
        step = step.drop("moved")
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            onward = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = cut(roots)
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        edges = edges.join(ends, "a").select(F.col("a2").alias("a"), "b")
        ends = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = cut(edges.join(ends, "b").select("a", F.col("b2").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            return roots
