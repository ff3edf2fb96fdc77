"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed


def _with_least(links: DataFrame) -> DataFrame:
    """links (a, b) with m, the least of a and all its b; a hub's links are never gathered, only their least."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return links.join(least, "a").withColumn("m", F.least("a", "least")).drop("least")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a long, b long); root is the least node that is reachable.

    Each round joins every link to the least neighbour of its end, in both directions (Kiveris et al. 2014);
    rounds grow with the logarithm of the links. Rounds are cut off by checkpoints. Self links and repeats are
    ignored; no links give no rows.
    """
    now = checkpointed(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _with_least(large)
        now = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        now = checkpointed(now.select("x.a", "x.b").filter("a <> b").distinct())
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
