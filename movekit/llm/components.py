"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movekit.session import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component`` for every end of the edges ``a, b``; the component is its smallest id.

    Alternating large-star and small-star steps; every step is an aggregation with partial minima and
    a join, written to shared storage, so no neighbourhood is ever held by one task and no lineage
    grows. The driver sees two numbers per round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stage(now, "cc-edges"), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        now = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a")
        now = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stage(now.where("a <> b").distinct(), "cc-edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
