"""Exact quantiles of groups of any size, by selection instead of sorting.

The ranks that a quantile needs are looked for in value ranges. A round cuts each range
into buckets by a monotone function of the value and counts them, one partial aggregate a
task; the bucket that holds a rank, between its own smallest and largest value, is the
next range. Ranges are cut evenly and by magnitude in turn, and a range's two ends have
buckets of their own, so every round but the evenly cut of huge spreads shortens it a
lot and none leaves it as it is. What is left of a range when it has few rows is fetched.
No task ever holds more than `small` values of a group, or its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import written

BUCKETS = 256
#: Values of a range that are fetched into one array.
SMALL = 10_000
#: Ranges of so many (group, rank) pairs are broadcast to the rows, more are joined by shuffle.
BROADCAST_RANGES = 200_000


def _magnitude(v: Column) -> Column:
    """A monotone function of a double that spreads values by their order of magnitude."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))


def _bucket(v: Column, lo: Column, hi: Column, by_magnitude: bool, buckets: int) -> Column:
    """0 at lo, buckets + 1 at hi, else 1 to buckets, never falling as v grows."""
    if by_magnitude:
        share = (_magnitude(v) - _magnitude(lo)) / F.nullif(_magnitude(hi) - _magnitude(lo), F.lit(0.0))
    else:
        share = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    usable = F.abs(share) < float("inf")  # not where an end is infinite or NaN
    inside = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)) + 1
    return F.when(v == lo, 0).when(v == hi, buckets + 1).otherwise(F.when(usable, inside).otherwise(1)).cast("int")


def selected(rows: DataFrame, targets: DataFrame, small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """(key, rank, v): the value of each rank, from 0, of targets (key, rank, lo, hi, below, count); rows has key and v, read once a round."""
    opened, found, round_no = written(targets, "ranges"), [], 0
    while True:
        found.append(opened.filter("lo = hi").select("key", "rank", F.col("lo").alias("v")))
        found.append(_fetched(rows, opened.filter(f"lo <> hi and count <= {small}")))
        wide = opened.filter(f"lo <> hi and count > {small}")
        n = wide.count()
        if not n:
            break
        ranges = wide.select(F.col("key").alias("of"), "lo", "hi").distinct()
        ranges = F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges
        met = rows.join(ranges, (F.col("key") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bucket = _bucket(F.col("v"), F.col("lo"), F.col("hi"), round_no % 2 == 1, buckets)
        counted = met.groupBy("of", "lo", "hi", bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = Window.partitionBy("of", "lo", "hi").orderBy("bucket")  # at most buckets + 2 rows
        counted = counted.withColumn("start", F.sum("rows").over(upto) - F.col("rows")).withColumnsRenamed({"lo": "of_lo", "hi": "of_hi"})
        within = (F.col("key") == F.col("of")) & (F.col("lo") == F.col("of_lo")) & (F.col("hi") == F.col("of_hi"))
        place = F.col("rank") - F.col("below")
        new = wide.join(counted, within & (place >= F.col("start")) & (place < F.col("start") + F.col("rows")))
        opened = written(new.select("key", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("start")).alias("below"), F.col("rows").alias("count")), "ranges")
        round_no += 1
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _fetched(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    ranges = narrow.select(F.col("key").alias("of"), "lo", "hi").distinct()
    met = rows.join(ranges, (F.col("key") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
    held = met.groupBy("of", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("values")).withColumnsRenamed({"lo": "of_lo", "hi": "of_hi"})
    within = (F.col("key") == F.col("of")) & (F.col("lo") == F.col("of_lo")) & (F.col("hi") == F.col("of_hi"))
    return narrow.join(held, within).select("key", "rank", F.element_at("values", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, fractions: Sequence[float], small: int = SMALL, buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, q): the number of values and their exact quantiles, linear between ranks, as an array in the order of fractions.

    Nulls do not count, a group of nulls alone has no row. Null keys are a group; without
    keys there is one row if there is a value. NaN is greater than all else. df is read once
    for the counts, once a round and once at the end; write it first if it is costly.
    """
    value = F.col(value) if isinstance(value, str) else value
    key = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("__all"))
    rows = df.select(key.alias("key"), value.cast("double").alias("v")).filter("v is not null")
    whole = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    place = [(F.col("n") - 1) * F.lit(float(f)) for f in fractions]
    ranks = F.array_distinct(F.array(*[x.cast("long") for p in place for x in (F.floor(p), F.ceil(p))]))
    targets = whole.select("key", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("count"))
    at = selected(rows, targets, small, buckets).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = whole.join(at.withColumnRenamed("key", "of"), F.col("key") == F.col("of"))

    def between(p: Column) -> Column:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        return F.when(low == high, F.element_at("at", low)).otherwise((high - p) * F.element_at("at", low) + (p - low) * F.element_at("at", high))

    return out.select(*[F.col(f"key.{k}").alias(k) for k in keys], "n", F.array(*[between(p) for p in place]).alias("q"))
