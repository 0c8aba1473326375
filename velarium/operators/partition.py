"""Balanced partitions of a graph: regions grown from several sets of seeds, the one with the fewest cut edges wins.

All starts grow in one table, hop by hop.  In each hop a node that no region
has yet goes to the region with most links to it; a region takes the nodes
with most links first, as far as its capacity allows.  Nodes that no region
reaches fill the free places in id order.  Hops are joins against the edges,
places inside a region come from a sort in ranges, and only a row for each
start and region is ever summed up.

Defined cases: edges are taken in both directions, once each; loops and edges
to unknown nodes do not count; a graph without edges is dealt out in id order;
no nodes give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .sampling import positions, seeded_sample


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a and b of every edge in both directions, once each; ends have to be among the nodes (node)."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    both = both.select("e.a", "e.b").where("a <> b").distinct()
    return both.join(nodes, F.col("a") == F.col("node"), "left_semi").join(nodes, F.col("b") == F.col("node"), "left_semi")


def grown(nodes: DataFrame, edges: DataFrame, parts: int, starts: int, capacity: int) -> DataFrame:
    """start, node, part for every start and node; ``edges`` as :func:`undirected` gives them."""
    seeds = None
    for s in range(starts):
        own = positions(cut(seeded_sample(nodes, "node", parts, s).withColumn("h", F.md5(F.concat(F.col("node").cast("string"), F.lit(f":{s}"))))), ["h", "node"], [], "part")
        own = own.select(F.lit(s).alias("start"), "node", "part")
        seeds = own if seeds is None else seeds.unionByName(own)
    state = cut(seeds)
    while True:
        asked = state.join(edges, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node"), "part").agg(F.count("*").alias("links"))
        asked = asked.join(state.select("start", "node"), ["start", "node"], "left_anti")
        best = asked.groupBy("start", "node").agg(F.max(F.struct("links", (-F.col("part")).alias("part"))).alias("x"))
        best = cut(best.select("start", "node", (-F.col("x.part")).alias("part"), (-F.col("x.links")).alias("fewest")))
        if best.isEmpty():
            break
        sizes = state.groupBy("start", "part").agg(F.count("*").alias("size"))
        taken = positions(best, ["fewest", "node"], ["start", "part"], "place").join(sizes, ["start", "part"])
        taken = cut(taken.where(F.col("size") + F.col("place") < capacity).select("start", "node", "part"))
        if taken.isEmpty():
            break
        state = cut(state.unionByName(taken))
    left = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")).join(state, ["start", "node"], "left_anti")
    sizes = state.groupBy("start", "part").agg(F.count("*").alias("size"))
    free = sizes.where(F.col("size") < capacity).select("start", "part", F.explode(F.sequence(F.lit(1), (capacity - F.col("size")).cast("int"))).alias("n"))
    free = positions(cut(free), ["part", "n"], ["start"], "place")
    filled = positions(cut(left.select("start", "node")), ["node"], ["start"], "place").join(free, ["start", "place"])
    return cut(state.unionByName(filled.select("start", "node", "part")))


def cut_edges(parted: DataFrame, edges: DataFrame) -> DataFrame:
    """start and the edges (counted once) between its parts."""
    ends = edges.where("a < b").join(parted.select("start", F.col("node").alias("a"), F.col("part").alias("p")), "a")
    ends = ends.join(parted.select("start", F.col("node").alias("b"), F.col("part").alias("q")), ["start", "b"])
    return ends.groupBy("start").agg(F.count_if(F.col("p") != F.col("q")).alias("cut"))


def partition(nodes: DataFrame, edges: DataFrame, parts: int, starts: int = 3) -> DataFrame:
    """node, part, start and cut of the best of ``starts`` partitions into parts of at most ceil(nodes / parts)."""
    nodes = nodes.select("node")
    both = cut(undirected(nodes, edges.select("src", "dst")))
    found = grown(nodes, both, parts, starts, max(1, -(-nodes.count() // parts)))
    cuts = cut_edges(found, both)
    best = found.select("start").distinct().join(cuts, "start", "left").select("start", F.coalesce("cut", F.lit(0)).alias("cut")).orderBy("cut", "start").limit(1)
    return found.join(F.broadcast(best), "start").select("node", F.col("part").cast("int").alias("part"), "start", "cut")  # one row
