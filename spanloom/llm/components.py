"""Connected components over a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two joins; links are cut from their lineage in the shared
checkpoint folder. The work follows the number of links, never the number of rows that have none. A node with a large share of the
links is joined by a broadcast of its one row, so its links stay where they are.

Edge cases: links from a node to itself and repeated links add nothing; links with a null end are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, hot_limit, join_hot


def _large_star(links: DataFrame, limit: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.where("v > u"), least, "u", limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, limit: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(links, least, "u", limit).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of whole numbers -> (node, component) for every node that has a link to another; component is the smallest node."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = checkpointed(links)
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        limit = hot_limit(2 * mark[0])  # a link counts for both of its nodes
        state = checkpointed(_small_star(checkpointed(_large_star(state, limit)), limit))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
