"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import save, scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) of every node of edges (a, b): the smallest node that links reach.

    Large stars hang a node's larger neighbours on its smallest one, small stars do so with the smaller ones; both only
    shuffle edges, which shrink to one a node, in a number of rounds about the logarithm of a component's size. Each round is
    a table in the shared folder; only the last one stays.
    """
    with scratch(edges.sparkSession) as keep:
        now = save(edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
        mark = _mark(now)
        while mark[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
            before, mark = mark, _mark(now)
            if mark == before:
                break
        keep(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
