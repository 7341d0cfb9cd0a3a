"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) of every end of the links (a, b): the smallest id that links lead to.

    Each round hangs all neighbours on the smallest one (large star, then small star), so paths
    shorten geometrically. Minima are aggregated before rows meet, and a round's links are
    written, so neither a large component nor the number of rounds gathers in one place.
    """
    now = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    seen, i = None, 0
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(sign) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen, i = tuple(sign), i + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        if i > 1:
            scratch.drop(f"{name}-{i - 2}")
