"""Connected components of a link table by alternating stars; every step is a join and an aggregate, staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.base import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links(a, b).  Nodes are longs; self links, copies and nulls add nothing.

    Hubs cost no group: minima are partial aggregates and the joins on a hub can be split.  Rounds grow with the logarithm of a chain's length."""
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = staged(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
