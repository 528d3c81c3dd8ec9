"""Connected components of small reference graphs by repeated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every node: the smallest one reachable. edges: (a, b), either direction.

    Each round takes the least label of the neighbours and then that label's own label, so
    chains shrink by halves; labels are written between rounds and compared by count.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    now = written(nodes.select("node", F.col("node").alias("root")).distinct(), "labels")
    while True:
        near = both.join(now, F.col("v") == F.col("node")).groupBy(F.col("u").alias("of")).agg(F.min("root").alias("near"))
        least = now.join(near, F.col("node") == F.col("of"), "left").select("node", F.least("root", "near").alias("mid"), F.col("root").alias("old"))
        jump = now.select(F.col("node").alias("at"), F.col("root").alias("next"))
        then = written(least.join(jump, F.col("mid") == F.col("at"), "left").select("node", F.least("mid", "next").alias("root"), "old"), "labels")
        moved = then.filter("root <> old").limit(1).count()
        now = then.select("node", "root")
        if not moved:
            return now
