"""Whole-cohort audits: structure, leakage and causality, with the number of violations and a reason for each record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.operators import quantiles

SPLITS = ("train", "validation", "test")


def cohort_audit(cohort: DataFrame, records: DataFrame, least_class: int = 2, least_groups: int = 2) -> DataFrame:
    """(check, n) for ten checks of a cohort (sample_id, label, group_id, split, source_ids by "|"); all 0 in a sound one.

    records has record_id. Leakage is counted in groups and in sources that are in more
    than one split, floors in missing pairs of split and class.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    valid = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    rows = cohort.agg(
        (F.count_if(blank("sample_id")) + F.count("sample_id") - F.countDistinct("sample_id")).alias("sample_id_empty_or_repeated"), F.count_if(~F.coalesce(F.col("label").isin("0", "1"), F.lit(False))).alias("label_invalid"),
        F.count_if(~valid).alias("split_invalid"), F.count_if(blank("group_id")).alias("group_missing"), F.count_if(blank("source_ids")).alias("source_missing"),
        *[F.count_if((F.col("split") == s) & (F.col("label") == c)).alias(f"n_{s}_{c}") for s in SPLITS for c in "01"],
    )
    short = sum((F.when(F.col(f"n_{s}_{c}") < least_class, 1).otherwise(0) for s in SPLITS for c in "01"), F.lit(0))
    rows = rows.withColumn("class_floor", short).drop(*[f"n_{s}_{c}" for s in SPLITS for c in "01"])
    groups = cohort.filter(~blank("group_id")).groupBy("group_id").agg(F.countDistinct("split").alias("k"), F.max((F.col("split") == "test").cast("int")).alias("tested"))
    groups = groups.agg(F.count_if(F.col("k") > 1).alias("group_leakage"), F.when(F.coalesce(F.sum("tested"), F.lit(0)) < least_groups, 1).otherwise(0).alias("test_group_floor"))
    used = cohort.select("split", F.explode(F.split("source_ids", "[|]")).alias("source_id")).filter("source_id <> ''")
    used = used.groupBy("source_id").agg(F.countDistinct("split").alias("k"))
    known = records.select(F.col("record_id").alias("r")).distinct()
    used = used.join(known, F.col("source_id") == F.col("r"), "left").agg(F.count_if(F.col("r").isNull()).alias("phantom_sources"), F.count_if(F.col("k") > 1).alias("source_leakage"))
    parts = [p.unpivot([], [F.col(c).cast("long").alias(c) for c in p.columns], "check", "n") for p in (rows, groups, used)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def causality_reason(issue: Column, lookback_hours: float, allow_assumed: bool = False, tolerance_minutes: int = 15) -> Column:
    """Why a record must not feed an issue, in fixed order of tests, else NULL.

    Columns: start, end, available (timestamps), basis, parameter. Stage thresholds are
    static and exempt from the lookback, whose lower bound has a tolerance.
    """
    basis = (F.col("basis") == "observed") | (F.col("basis") == "assumed") & F.lit(allow_assumed)
    earliest = issue - F.expr(f"INTERVAL '{int(lookback_hours * 60) + tolerance_minutes}' MINUTE")
    return (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "interval_missing").when(F.col("start") > F.col("end"), "interval_inverted")
        .when(~F.coalesce(basis, F.lit(False)), "release_evidence_missing").when(F.col("available").isNull(), "release_time_missing").when(F.col("end") > issue, "observed_after_issue")
        .when(~F.contains("parameter", F.lit("flood_stage")) & (F.col("end") < earliest), "before_lookback")
        .when(F.col("available") < F.col("end"), "released_before_closure").when(F.col("available") > issue, "released_after_issue")
    )


def causality(records: DataFrame, sample: str, issue: Column, lookback_hours: float, **options: bool | int) -> DataFrame:
    """(sample, reason, n, earliest, latest): records by reason; a sample is sound if its reasons are NULL alone.

    A record id that a sample repeats is a reason as well. Ids repeat if they are in more than one row.
    """
    twice = records.groupBy(sample, "record_id").agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("start", "end", "available", "basis", "parameter")])
    reason = F.when(F.col("k") > 1, "record_repeated").otherwise(causality_reason(issue, lookback_hours, **options))
    return twice.groupBy(sample, reason.alias("reason")).agg(F.sum("k").alias("n"), F.min("end").alias("earliest"), F.max("end").alias("latest"))


def latency(rows: DataFrame, keys: Sequence[str], millis: str, order: str, warm_up: int = 10) -> DataFrame:
    """Mean, population spread, median, 95th percentile, extremes and throughput of runs behind the first `warm_up` of each key.

    The places of the warm-up are found by a limited window, so no key is sorted whole.
    """
    first = _nth(rows, keys, order, warm_up)
    x = F.col(millis)
    counted = written(rows.join(first, list(keys)).filter(F.col(order) > F.col("warm")).select(*keys, millis), "runs")
    middle = quantiles.quantiles(counted, keys, millis, [0.5, 0.95]).drop("n")
    out = counted.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_ms"), F.stddev_pop(x).alias("sd_ms"),
        F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), F.when(F.avg(x) > 0, 1000 / F.avg(x)).otherwise(F.lit(0.0)).alias("per_second"),
    )
    return out.join(middle, list(keys)).withColumns({"p50_ms": F.col("q")[0], "p95_ms": F.col("q")[1]}).drop("q")


def _nth(rows: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n-th smallest `order` of each key; Spark limits the window's rows before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.select(*keys, order).withColumn("nth", nth).filter(F.col("nth") <= n).groupBy(*keys).agg(F.max(order).alias("warm"))
