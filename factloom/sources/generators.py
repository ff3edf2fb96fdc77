"""Generated facts for measurements: trees and random graphs of any size, by expressions over a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import fact


def tree(spark: SparkSession, n: int, branch: int, graph: str = "?tree") -> DataFrame:
    """n facts of a tree in which node k is the parent of k * branch + 1 up to k * branch + branch."""
    child = F.col("id") + 1
    parent = F.floor((child - 1) / branch)
    return spark.range(n).select(fact(graph, ("/tn", parent), "parent_of", node=("/tn", child)))


def random_graph(spark: SparkSession, nodes: int, n: int, seed: int = 0, graph: str = "?random") -> DataFrame:
    """n distinct pairs of nodes; n is at most nodes * nodes."""
    if n > nodes * nodes:
        raise ValueError(f"{nodes} nodes have {nodes * nodes} pairs")
    # a step that shares no factor with the number of pairs visits each pair once
    total, step = nodes * nodes, 2654435761
    from math import gcd

    while gcd(step, total) > 1:
        step += 2
    pair = F.pmod((F.col("id").cast("decimal(38,0)") * step + seed), F.lit(total)).cast("bigint")
    return spark.range(n).select(fact(graph, ("/gn", F.floor(pair / nodes)), "follow", node=("/gn", F.pmod(pair, F.lit(nodes)))))
