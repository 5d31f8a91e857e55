"""Connected components of an edge table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_stage, stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, root)``, root the smallest id that the
    node reaches. Nodes without an edge have no row; loops and repeats are allowed.

    Each round links every node's larger neighbours to its smallest neighbour, then
    its smaller ones; the number of edges never grows, and rounds grow with the
    logarithm of the longest path. All steps are grouped minima and joins, so a node
    with very many edges is split by partial aggregation and skew-join handling.
    Edge tables are written to the shared folder each round."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        near = big.join(low, "u")
        last, e = e, stage(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                  .unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete_stage(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
