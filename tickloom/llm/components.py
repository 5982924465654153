"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_by_frequency

#: Links of a node that one task may hold; those of nodes with more are scattered.
HUB_LINKS = 100_000


def connected_components(links: DataFrame, nodes: DataFrame, max_rounds: int = 100, hub_links: int = HUB_LINKS) -> DataFrame:
    """(node, label): the least ``label`` of each node's component (null if all are).

    ``links``: (src, dst); ``nodes``: (node, label), a row per node.  Alternates
    large-star and small-star steps until the links no longer change; RuntimeError
    after ``max_rounds``, of which a component takes about the logarithm of its
    diameter.  Least neighbours are aggregated with map-side combine.  Joins bring
    them back to the links; while some node has more than ``hub_links`` links, that
    of frequent nodes goes by broadcast and a scattered key, so no task holds them.
    Each round is cut off by a checkpoint in the shared folder.
    """
    edges = checkpointed(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())

    def both_ways(frame: DataFrame) -> DataFrame:
        return frame.unionByName(frame.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(frame: DataFrame) -> tuple[int, tuple]:
        """(links of the node with most, what tells this set of links from others)."""
        each = both_ways(frame).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        row = each.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.sum("n").alias("n"), F.sum("h").alias("h")).first()
        return row.most, (row.n, row.h)

    def joined(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
        return join_by_frequency(left, right, [key], "n") if most > hub_links else left.join(right.drop("n"), key)

    def least_of(frame: DataFrame) -> DataFrame:
        return frame.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    most, now = state(edges)
    for _ in range(max_rounds):
        if not most:
            break
        both = both_ways(edges)
        large = joined(both, least_of(both).select("u", F.least("u", "m").alias("m"), "n"), "u", most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = joined(large, least_of(large), "u", most).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = checkpointed(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        before = now
        most, now = state(edges)
        if before == now:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    # stars: every node points at its root; a root's label is the least of its members'
    roots = nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", "label", F.coalesce("root", "node").alias("root"))
    labels = roots.groupBy("root").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    return joined(roots.select("node", "root"), labels, "root", most).select("node", "label")
