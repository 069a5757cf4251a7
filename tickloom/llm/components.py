"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop_stored, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every node's neighbours are tied to the least node among them and itself.

    Large-star moves the neighbours above the node, small-star those below it. The minimum comes from a
    grouped minimum joined back on the node, so that a node with very many neighbours is never gathered.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        both = both.where("v <= u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is tied to one other only, and that one to none: then each is tied to its component's least."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("ties")), F.struct(F.col("v").alias("node"), F.lit(0).alias("ties"))))
    ties = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.ties").alias("up"), F.min("e.ties").alias("least"))
    return ties.where("up > 1 or (up > 0 and least = 0)").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``links(u, v)``; component is the least node reachable.

    Each round costs a fixed number of shuffles of the remaining links and is written to the shared folder; the
    number of rounds grows with the logarithm of the longest path, so ``max_rounds`` is out of reach; should links not
    settle by then, that is an error. A link of a node with itself ties nothing; no links give no rows.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        after = stored(_star(_star(edges, small=False), small=True), "links")
        drop_stored(edges)
        edges = after
    else:
        raise RuntimeError("the components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


