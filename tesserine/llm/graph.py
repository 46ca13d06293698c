"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges`` (``u``, ``v``, longs): the smallest node reachable, itself included.

    The node that is its component's smallest has no row.  A round joins edges with one minimum a node, so a node with
    very many edges is a skewed join and no more; the rounds grow as the logarithm of the longest path.
    """
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        # e points down (v < u); the pairs whose far end lies above the node in the middle are those of e, turned round
        large = cut(e.select(F.col("v").alias("mid"), F.col("u").alias("far")).join(low.withColumnRenamed("u", "mid"), "mid").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        down = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_cut(e, low, large, least)
        e, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found.cut_to = e.cut_to
    return found
