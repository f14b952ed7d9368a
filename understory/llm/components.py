"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.keys import join_by_frequency
from understory.sources.shared import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Alternates two steps that keep the components and shrink every tree: each node's
    larger neighbours, then its smaller ones, are linked to its smallest neighbour.
    A node's neighbours are never gathered; only their minimum is, which combines
    before the shuffle, and nodes with very many neighbours are sent to the links
    instead of the other way round. Ends when every node hangs on its smallest one, after
    about log of the longest path rounds. Edges of null or equal ends are no links.
    Rounds are written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    pairs = cut_lineage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        large = cut_lineage(_star(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))))
        small = cut_lineage(_star(large, with_self=True))
        state = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        pairs, before = small, state
    own = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def _star(links: DataFrame, with_self: bool = False) -> DataFrame:
    """Link the neighbours b of a to the smallest among them and a; pairs come back as larger, smaller.

    With all links in both directions the larger neighbours are linked, with
    ``with_self`` (links point to smaller nodes) the smaller ones and the node.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = cut_lineage(least.select("a", F.least("a", "m").alias("m"), "n"))
    met = join_by_frequency(links, least, "a", "n")
    if with_self:
        out = met.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        out = met.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
