"""Connected components of links between documents, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of ``links`` (``a``, ``b``).

    Every round joins each node's neighbours to its smallest one, alternately over the larger neighbours
    only and over the smaller ones only, until each node hangs directly on its root. Nulls link nothing.
    """
    edges = stored(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where(
        F.col("lo") < F.col("hi")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select(
            "lo", F.least("lo", "m").alias("m"))
        large = both.join(least, "lo").where(F.col("hi") > F.col("lo")).select(
            F.col("m").alias("lo"), "hi").where(F.col("lo") < F.col("hi")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select("m", "lo", "hi")
        moved = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where(F.col("lo") < F.col("hi"))
        edges = stored(moved.union(low.select(F.col("m").alias("lo"), F.col("hi"))).distinct())
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
