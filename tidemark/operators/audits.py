"""Audits: leakage between splits, lineage, embargoes, complete comparisons, digests, invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaking_groups(samples: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose samples are in more than one split."""
    return samples.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n")).filter("n_splits > 1")


def phantoms(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Source ids that no record has."""
    return children.select(child).distinct().join(parents.select(F.col(parent).alias(child)), child, "left_anti")


def bridge(samples: DataFrame, ids: str, separator: str = "|") -> DataFrame:
    """Samples exploded to one row a source id."""
    return samples.withColumn("source_id", F.explode(F.split(ids, f"[{separator}]"))).drop(ids)


def bridged(samples: DataFrame, ids: str, records: DataFrame, record_id: str, separator: str = "|") -> DataFrame:
    """Samples joined with the record of each source id; an id that no record has raises."""
    met = bridge(samples, ids, separator).join(records.withColumn("__known", F.lit(True)), F.col("source_id") == F.col(record_id), "left")
    known = F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no record has source id "), F.col("source_id"))).cast("boolean"))
    return met.filter(known).drop("__known")


def embargo(parts: DataFrame, splits: Sequence[str], hours: float) -> DataFrame:
    """Partitions (cluster, part, split, t_start, t_end) too close behind one of another split in their cluster.

    A sweep by start time against the latest end of each other split: linear, no pairs.
    """
    earlier = Window.partitionBy("cluster").orderBy("t_start", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.when(F.col("split") != s, F.max(F.when(F.col("split") == s, F.col("t_end"))).over(earlier)) for s in splits]
    out = parts.withColumn("latest_end", F.greatest(*ends) if len(ends) > 1 else ends[0])
    gap = (F.col("t_start") - F.col("latest_end")) / 3_600_000_000
    out = out.withColumn("gap_hours", gap).filter(F.col("gap_hours") < hours)
    return out.select("cluster", "part", "split", F.round("gap_hours", 3).alias("gap_hours"), (F.col("gap_hours") <= 0).alias("overlaps"))


def compare(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Complete comparison of two keyed series: one row of counts; missing or extra keys fail it."""
    a, b = left.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")), right.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    d = F.abs(F.col("a") - F.col("b"))
    out = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_common"), F.count_if(F.col("in_b").isNull()).alias("n_missing"),
        F.count_if(F.col("in_a").isNull()).alias("n_extra"), F.max(d).alias("max_diff"),
    )
    return out.withColumn("within", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("max_diff") <= tolerance))


def line_digest(rows: DataFrame, keys: Sequence[str], line: Column, *extra: Column) -> DataFrame:
    """keys, extra aggregates (of rows) and digest of each key's lines, in two levels.

    Lines are bucketed by the first three digits of their SHA-256; a bucket's digest is that of
    its sorted lines, the key's digest that of its buckets' digests in order. No array holds
    a key's lines: one bucket has a 4096th of them.
    """
    lined = rows.withColumn("__line", line).withColumn("__bucket", F.substring(F.sha2("__line", 256), 1, 3))
    each = lined.groupBy(*keys, "__bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("__d"))
    whole = each.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__bucket", "__d"))), lambda x: x["__d"]), "\n"), 256).alias("digest"))
    return whole.join(rows.groupBy(*keys).agg(F.count("*").alias("n"), *extra), list(keys))


def ancestry(rows: DataFrame, key: str, line: Column, t: str) -> DataFrame:
    """Time range, number of sources and the digest of the source lines of each sample."""
    return line_digest(rows, [key], line, F.min(t).alias("earliest"), F.max(t).alias("latest")).withColumnRenamed("n", "n_sources")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is NULL is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))
