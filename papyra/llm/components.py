"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.scratch import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's neighbours to the least node among them and itself.

    Large-star keeps the neighbours above the node, small-star those below it and the
    node itself.  The least neighbour is a grouped minimum, combined before the shuffle,
    so a node with very many neighbours costs one row per task.
    """
    both = edges if small else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").unionAll(least.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), "m")
    out = out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
    return out.distinct() if small else out


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge.

    ``edges`` has two long columns u and v.  Every edge points from the greater to the
    lesser node; rounds alternate until the edges are stars around the least node of each
    component.  Each round is written to the shared folder, and the one before deleted.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(pairs, "edges")
    sign = None
    for _ in range(max_rounds):
        nxt = scratch.save(_star(_star(now, small=False), small=True), "edges")
        after = nxt.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = nxt
        if after == sign:
            break
        sign = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
