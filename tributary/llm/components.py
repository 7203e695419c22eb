"""Connected components of a table of links, by alternating large-star and small-star steps on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.shared import drop, save


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root): root is the least node reachable. Nodes that are roots have no row.

    Each step points a node's neighbours at the least of them, so a star of any size stays one row per node, and the
    number of steps grows with the logarithm of a component's diameter. Only two numbers a step reach the driver.
    """
    pairs = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "pairs")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, pairs = pairs, save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "pairs")
        drop(old)
        new = _state(pairs)
        if new == state:
            break
        state = new
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
