"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a partially aggregated minimum and a join; tables are stashed after each
round, so lineage stays short, and nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b, distinct."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), F.least("u", "least").alias("m"))
    # stashed, so that the join reads two plain exchanges, whose skewed partitions Spark can split: a hub has many links
    least = stash(least, "least")
    met = both.join(least, F.col("u") == F.col("of"))
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link.

    links: (a, b) of one orderable type, in either direction; nulls and loops are ignored.
    """
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    while True:
        large = _star(now, large=True)
        then = stash(_star(large, large=False), "links")
        same = then.count() == now.count() and then.join(now, ["a", "b"], "left_anti").limit(1).count() == 0
        now = then
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
