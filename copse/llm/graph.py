"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the least among them and itself: the larger ones (large) or the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    # the neighbours join on a copy of the key, so that the rows of a hot node can be split
    out = both.withColumn("at", F.col("a") + F.lit(0)).join(least.withColumn("at", F.col("of") + F.lit(0)), "at")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b: long); root is the least node of its component.

    Loops and repeated edges do no harm; an empty table gives none.  Each round
    is written to the shared checkpoint folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or state.n == 0:
            break
        seen = state
        now = cut(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
