"""Connected components in few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.plans.keyed import hot_keys, join_per_key
from ridelake.plans.session import cut


def _mark(links: DataFrame) -> tuple:
    """Tells sets of links apart; equal sets have equal marks."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _to_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with the least node of u; a node with very many links is dealt to several tasks."""
    return join_per_key(links, least, ["u"], "inner", hot=hot_keys(links, ["u"]))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) between longs; the root is the component's least node.

    Large and small stars in turn: nodes link all larger neighbours to the least one they see, then the smaller ones. Distances
    halve in each round, so a chain of n links takes about log2(n) rounds, and only minima per node are shuffled beside links.
    """
    one = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    stars = cut(links.select(*one).where("u > v").distinct())
    before, mark = None, _mark(stars)
    while mark != before:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cut(_to_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = _to_least(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(stars)
    alone = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return alone.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
