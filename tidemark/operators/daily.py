"""Daily operators: dense calendars, exact Type-8 thresholds, the five-state trace, issue labels.

Everything is windows over (site, date); a site's calendar bounds its window. Missing days
stay rows of their own, and a label that cannot be known is NULL or 'unknown', never no.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARM_DAYS = 3


def calendarize(values: DataFrame, start: str, end: str, keys: Sequence[str] = ("site",)) -> DataFrame:
    """A row for every key and date of the half-open calendar; absent dates are missing_date."""
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("local_date")
    slots = values.select(*keys).distinct().select(*keys, dates)
    return slots.join(values, [*keys, "local_date"], "left").withColumn("quality", F.coalesce("quality", F.lit("missing_date")))


def usable(lane: Column) -> Column:
    """Truth lanes: 'primary' takes estimated days as well, 'unflagged' only approved ones."""
    return F.col("value").isNotNull() & ((F.col("quality") == "approved_unflagged") | ((F.col("quality") == "estimated_flagged") & (lane == "primary")))


def type8(values: DataFrame, keys: Sequence[str], value: str, a: int, b: int) -> DataFrame:
    """Exact Type-8 (median-unbiased) quantile a/b of each key with two values or more.

    The quantile is lo + (hi - lo) * g_num / g_den, kept as exact parts: position
    a(3n+1)+b over 3b, clamped to the sample. Few ranks per key survive the filter.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = values.filter(F.col(value).isNotNull()).withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(*keys))})
    num, den = F.lit(a) * (3 * F.col("n") + 1) + b, F.lit(3 * b)
    clamped = F.least(F.greatest(num, den), F.col("n") * den)
    ranked = ranked.withColumns({"j": F.expr(f"least(greatest({a} * (3 * n + 1) + {b}, {3 * b}), n * {3 * b}) div {3 * b}"), "num": clamped})
    at = lambda k: F.max(F.when(F.col("i") == F.least(F.col("j") + k, F.col("n")), F.col(value)))
    return (
        ranked.filter("n >= 2 and i between j and j + 1").groupBy(*keys, "n")
        .agg(at(0).alias("lo"), at(1).alias("hi"), F.max(F.col("num") - F.col("j") * den).alias("g_num"))
        .withColumn("g_den", den.cast("long"))
    )


def above(value: Column) -> Column:
    """value > lo + (hi - lo) * g_num / g_den, by cross-multiplication."""
    return F.col("g_den") * (value - F.col("lo")) > F.col("g_num") * (F.col("hi") - F.col("lo"))


def state_trace(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The armed/active recurrence in window form.

    days has keys, local_date and class (U unusable, H above, L not above), one row a
    calendar date. A high day completes only if the three days before were low.
    """
    by_day = Window.partitionBy(*keys).orderBy("local_date")
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.col("class") == "L", F.col("class") == "H"
    out = days.withColumn("island", F.sum((~low).cast("int")).over(upto))
    in_island = Window.partitionBy(*keys, "island").orderBy("local_date")
    # an island opens with its own day that is not low, but for the first
    out = out.withColumn("low_run", F.when(low, F.row_number().over(in_island) - (F.col("island") > 0).cast("int")).otherwise(0))
    out = out.withColumn("completion", high & (F.lag("low_run", 1, 0).over(by_day) >= ARM_DAYS))
    anchor = F.last(F.when(F.col("completion"), "C").when(F.col("class") == "U", "U"), ignorenulls=True).over(upto)
    state = (
        F.when(F.col("class") == "U", "unresolved").when(low & (F.col("low_run") >= ARM_DAYS), "armed")
        .when(F.col("anchor") == "C", F.when(high, "active").otherwise("recovering")).when(F.col("anchor") == "U", "unresolved")
        .when(F.col("highs") > 0, "unresolved").otherwise("unarmed_initial")
    )
    out = out.withColumns({"anchor": anchor, "highs": F.sum(high.cast("int")).over(upto), "ordinal": F.sum(F.col("completion").cast("int")).over(upto)})
    out = out.withColumn("state_after", state)
    out = out.withColumn("state_before", F.lag("state_after", 1, "unarmed_initial").over(by_day))
    disarmed = F.col("state_before").isin("active", "recovering")
    transition = (
        F.when(F.col("class") == "U", "missing_or_unusable_break")
        .when(high, F.when(F.col("state_before") == "armed", "qualifying_completion").when(disarmed, "same_disarmed_episode").otherwise("censored_high_without_armed_predecessor"))
        .when(F.col("state_before") == "armed", "remain_armed")
        .when(disarmed, F.when(F.col("state_after") == "armed", "rearmed_after_three_below").otherwise("recovery_below_day"))
        .when(F.col("state_after") == "armed", "armed_after_three_below")
        .when(F.col("state_before") == "unarmed_initial", "initial_below_accumulation").otherwise("unresolved_below_accumulation")
    )
    return out.withColumn("transition", transition).withColumn("below_run", F.least(F.col("low_run"), F.lit(ARM_DAYS))).drop("island", "anchor", "highs")


def issue_labels(trace: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (24, 48, 72)) -> DataFrame:
    """Three-valued labels of every noon issue and horizon.

    A day closes at the next midnight, so an issue at noon of day D sees the state after
    D-1, and a horizon of h days closes days D to D+h-1: frames of the same window, no
    join. Days past the calendar make a label unknown.
    """
    by_day = Window.partitionBy(*keys).orderBy("local_date")
    state = F.lag("state_after", 1, "unarmed_initial").over(by_day)
    open_day = (F.col("class") == "U") | (F.col("transition") == "censored_high_without_armed_predecessor")
    found = []
    for h in horizons:
        ahead = by_day.rowsBetween(0, h // 24 - 1)
        first = F.min(F.when(F.col("completion"), F.col("local_date"))).over(ahead)
        found.append(F.struct(
            F.lit(h).alias("horizon"), F.sum(F.col("completion").cast("long")).over(ahead).alias("n_targets"),
            (F.lit(h // 24) - F.count("*").over(ahead) + F.sum(open_day.cast("long")).over(ahead)).alias("n_unusable"),
            (24 * F.datediff(first, F.col("local_date")) + 12).cast("long").alias("lead_hours"),
        ))
    out = trace.withColumn("issue_state", state).withColumn("hs", F.array(*found)).withColumn("h", F.explode("hs"))
    out = out.select(*keys, F.col("local_date").alias("issue_date"), "issue_state", "h.*")
    status = F.when(F.col("issue_state") != "armed", "unknown").when(F.col("n_targets") > 0, "positive").when(F.col("n_unusable") > 0, "unknown").otherwise("negative")
    reason = (
        F.when(F.col("issue_state") != "armed", F.concat(F.lit("issue_state_not_armed:"), "issue_state"))
        .when(F.col("n_targets") > 0, "definite_completion").when(F.col("n_unusable") > 0, "future_truth_incomplete").otherwise("complete_closures")
    )
    return out.withColumns({"status": status, "reason": reason})


def latest_admissible(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As-of: the latest approved day closed at each noon issue, with its age in hours."""
    before = Window.partitionBy(*keys).orderBy("local_date").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when((F.col("quality") == "approved_unflagged") & F.col("value").isNotNull(), F.struct("local_date", "value"))
    out = days.withColumn("found", F.last(good, ignorenulls=True).over(before))
    return out.select(
        *keys, F.col("local_date").alias("issue_date"), F.col("found.value").alias("score"), F.col("found.local_date").alias("source_date"),
        (24 * F.datediff("local_date", "found.local_date") - 12).cast("long").alias("age_hours"),
    )


def previous_closed_day(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The expected day before each issue, or the reason why it gives no score; never an older one."""
    by_day = Window.partitionBy(*keys).orderBy("local_date")
    before = F.lag(F.struct("local_date", "quality", "value")).over(by_day)
    out = days.withColumn("b", before)
    status = (
        F.when(F.col("b").isNull(), "no_score_no_expected_closed_day").when(F.col("b.quality") == "missing_date", "no_score_missing_latest_expected_row")
        .when(F.col("b.quality") != "approved_unflagged", F.concat(F.lit("no_score_latest_row_quality_"), F.col("b.quality"))).otherwise("scored")
    )
    out = out.withColumn("status", status)
    return out.select(
        *keys, F.col("local_date").alias("issue_date"), "status", F.when(F.col("status") == "scored", F.col("b.value")).alias("score"),
        F.when(F.col("status") == "scored", F.lit(12)).cast("long").alias("age_hours"),
    )
