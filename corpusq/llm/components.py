"""Connected components of links in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their
    ends by pointer jumping, and replaces links by links between these ends. Only nodes that
    are smallest among their neighbours are left, so few rounds are needed; what is left of
    the links shrinks each time. Nothing is gathered per node but a minimum.
    """
    both = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = cut_lineage(both)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        hooks = cut_lineage(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        while True:
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hooks = cut_lineage(
                hooks.join(further, "to", "left").select(
                    "from", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
                )
            )
            moved = not hooks.where("moved").isEmpty()
            hooks = hooks.select("from", "to")
            if not moved:
                break
        roots = cut_lineage(
            roots.join(hooks, roots["root"] == hooks["from"], "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        )
        ends = [hooks.select(F.col("from").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved_edges = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")
        )
        edges = cut_lineage(
            moved_edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        )
    return roots
