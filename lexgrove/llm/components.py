"""Connected components by large-star and small-star rounds, with edges in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links a node's larger (or its other) neighbours to the least of the node and its neighbours."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = both.join(least.hint("merge"), "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for each node that an edge (u, v) names, the least node that it reaches.

    Each round reads and writes all edges; a hot node's neighbours are never gathered in one task.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nothing = F.lit(0).cast("decimal(38,0)")
    state = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), nothing)).first()
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        last, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(last)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components haven't settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
