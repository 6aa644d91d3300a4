"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import cut, drop_table


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); the root is the smallest node of its component.

    A step is aggregates with map-side combine, whose results are tables, and joins with them: a small table is sent to the
    links, for a large one Spark splits a node with very many links. Each step is cut, so a lost executor costs one step. The
    steps stop when a checksum of the links stays as it was.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, seen = cut(pairs, "links"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m")), "least")
        large = cut(both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        first = cut(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        small = large.join(first, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        new = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        for used in (current, least, large, first):
            drop_table(used)
        mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        current = new
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
