"""Operators on observation series: episodes, onsets, persistent alerts, as-of visibility, sequential folds.

Wherever a recurrence has a window form it is written as windows over (site, time). The
true folds (cooldown, control charts) are ordered scans: rows arrive sorted, the state of
one site is carried along, and no site's rows are gathered in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def episodes(obs: DataFrame, threshold: float, separation_hours: int = 24) -> DataFrame:
    """Threshold episodes of each site (columns site, obs_id, t in microseconds, value).

    A dip ends an episode if its observations below the threshold span the separation;
    otherwise the exceedances merge. Starting above is left-censored; an episode whose
    last dip does not separate is right-censored and has no end. Equal peaks: the latest.
    """
    by_time = Window.partitionBy("site").orderBy("t", "obs_id")
    above = F.col("value") >= threshold
    rows = obs.withColumns({"above": above, "previous": F.lag("t").over(by_time)})
    rows = rows.withColumn("nth", F.sum(F.col("above").cast("long")).over(by_time.rowsBetween(Window.unboundedPreceding, 0))).filter("nth > 0")
    below_t = F.when(~F.col("above"), F.col("t"))
    up = F.when(F.col("above"), F.col("t"))
    each = rows.groupBy("site", "nth").agg(
        F.max(up).alias("t"), F.max(F.when(F.col("above"), F.col("value"))).alias("value"), F.max(F.when(F.col("above"), F.col("previous"))).alias("previous"), (F.max(below_t) - F.min(below_t)).alias("dip")
    )
    by_nth = Window.partitionBy("site").orderBy("nth")
    apart = F.coalesce(F.lag("dip").over(by_nth) >= separation_hours * HOUR, F.lit(False))
    each = each.withColumn("starts", (F.col("nth") == 1) | apart)
    each = each.withColumn("episode", F.sum(F.col("starts").cast("long")).over(by_nth.rowsBetween(Window.unboundedPreceding, 0)))
    out = each.groupBy("site", "episode").agg(
        F.min_by("previous", "nth").alias("onset_lower"), F.min("t").alias("onset_upper"), F.max(F.struct("value", "t")).alias("peak"),
        F.max("t").alias("last_t"), F.max_by("dip", "nth").alias("last_dip"), F.min("nth").alias("first_nth"),
    )
    closed = F.coalesce(F.col("last_dip") >= separation_hours * HOUR, F.lit(False))
    return out.select(
        "site", "episode", "onset_lower", "onset_upper", F.col("peak.t").alias("peak_t"), F.col("peak.value").alias("peak_value"),
        F.when(closed, F.col("last_t")).alias("end_t"), F.when(closed, F.col("last_t") - F.col("onset_upper")).alias("duration"),
        F.col("onset_lower").isNull().alias("left_censored"), (~closed).alias("right_censored"),
    )


def onsets(rows: DataFrame, threshold: float, rearm_days: int = 3) -> DataFrame:
    """Onset flag, lower bound and at-risk state of each slot (columns site, day, value or null, usable).

    Contiguous usable low slots over the rearm span end an episode; a gap or an unusable
    slot resets the run but not the last low time. at_risk is NULL where truth is missing.
    """
    by_day = Window.partitionBy("site").orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    klass = F.when(~F.col("usable") | F.col("value").isNull(), "U").when(F.col("value") <= threshold, "L").otherwise("H")
    r = rows.withColumn("class", klass).withColumn("breaks", (F.col("class") != "L") | (F.datediff("day", F.lag("day").over(by_day)) != 1))
    r = r.withColumn("island", F.sum(F.coalesce("breaks", F.lit(True)).cast("long")).over(upto))
    low = F.when(F.col("class") == "L", F.col("day"))
    r = r.withColumn("low_start", F.min(low).over(Window.partitionBy("site", "island")))
    marker = F.when(F.col("class") == "H", "H").when((F.col("class") == "L") & (F.datediff("day", "low_start") >= rearm_days), "R")
    r = r.withColumn("marker", marker)
    free = lambda frame: F.coalesce(F.last("marker", ignorenulls=True).over(frame), F.lit("R")) == "R"
    return r.select(
        "site", "day", "class", ((F.col("class") == "H") & free(before)).alias("is_onset"),
        F.when((F.col("class") == "H") & free(before), F.last(low, ignorenulls=True).over(before)).alias("onset_lower"),
        F.when(F.col("class") == "U", None).when(F.col("class") == "H", False).otherwise(free(upto)).alias("at_risk"),
    )


def first_persistent(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """The day on which k contiguous slots at or above the threshold are first complete."""
    by_day = Window.partitionBy("site").orderBy("day")
    high = F.coalesce(F.col("value") >= threshold, F.lit(False))
    r = rows.withColumn("high", high).withColumn("breaks", ~F.col("high") | (F.datediff("day", F.lag("day").over(by_day)) != 1))
    r = r.withColumn("island", F.sum(F.coalesce("breaks", F.lit(True)).cast("long")).over(by_day))
    run = F.sum(F.col("high").cast("long")).over(Window.partitionBy("site", "island").orderBy("day"))
    return r.withColumn("run", run).filter(F.col("high") & (F.col("run") >= k)).groupBy("site").agg(F.min("day").alias("alert_day"))


def visible(obs: DataFrame, issues: DataFrame) -> DataFrame:
    """Bitemporal as-of: for each issue the observations both ended and available by then.

    obs: site, t_end, t_available, value. issues: site, t_issue. Observations and issues are
    one sorted stream, so this is a running window and no inequality join.
    """
    seen = obs.select("site", F.greatest("t_end", "t_available").alias("t"), F.lit(0).alias("is_issue"), F.struct("t_end", "value").alias("o"))
    marks = issues.select("site", F.col("t_issue").alias("t"), F.lit(1).alias("is_issue"), F.lit(None).cast(seen.schema["o"].dataType).alias("o"))
    upto = Window.partitionBy("site").orderBy("t", "is_issue").rowsBetween(Window.unboundedPreceding, 0)
    both = seen.unionByName(marks).withColumns({"n_visible": F.count("o").over(upto), "latest": F.max("o").over(upto)})
    return both.filter("is_issue = 1").select("site", F.col("t").alias("t_issue"), "n_visible", F.col("latest.t_end").alias("latest_t"), F.col("latest.value").alias("latest_value"))


def ordered_scan(df: DataFrame, key: str, order: Sequence[str], step: Callable[[dict | None, tuple], tuple[dict, tuple | None]], schema: str) -> DataFrame:
    """Fold each key's rows in order; step takes the state (None at first) and a row, and gives the new state and an output row or None.

    Rows stream through a task sorted by key: memory holds one batch and one state.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        names = [x.strip().split()[0] for x in schema.split(",")]
        for batch in batches:
            at = batch.columns.get_loc(key)
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[at] != held:
                    held, state = row[at], None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(scan, schema)


def cooldown(alerts: DataFrame, hours: float) -> DataFrame:
    """Alerts (site, t, obs_id) at least `hours` after the last one kept."""

    def step(state, row):
        site, t, obs_id = row
        if state is not None and t - state["t"] < hours * HOUR:
            return state, None
        return {"t": t}, (site, t, obs_id)

    return ordered_scan(alerts.select("site", "t", "obs_id"), "site", ("t", "obs_id"), step, "site long, t long, obs_id long")


def ewma_cusum(obs: DataFrame, mean: float, scale: float, alpha: float, slack: float) -> DataFrame:
    """EWMA and one-sided CUSUM of its standardised excess, site by site (site, t, obs_id, value)."""

    def step(state, row):
        site, t, obs_id, value = row
        ewma, total = (mean, 0.0) if state is None else (state["ewma"], state["cusum"])
        ewma = alpha * float(value) + (1 - alpha) * ewma
        total = max(0.0, total + (ewma - mean) / scale - slack)
        return {"ewma": ewma, "cusum": total}, (site, t, obs_id, ewma, total)

    return ordered_scan(obs.select("site", "t", "obs_id", F.col("value").cast("double").alias("value")), "site", ("t", "obs_id"), step, "site long, t long, obs_id long, ewma double, cusum double")


def control_step(state: dict | None, value: float | None, mean: float, scale: float, alpha: float, leak: float, slack: float) -> tuple[dict, float | None]:
    """One step of the leaky chart; a missing value decays the state and gives no score."""
    ewma, total = (mean, 0.0) if state is None else (state["ewma"], state["cusum"])
    missing = value is None or value != value
    ewma = 0.15 * mean + 0.85 * ewma if missing else alpha * value + (1 - alpha) * ewma
    z = (ewma - mean) / (scale * (alpha / (2 - alpha)) ** 0.5)
    total = leak * total if missing else max(0.0, leak * total + z - slack)
    return {"ewma": ewma, "cusum": total}, None if missing else 0.5 * z + 0.5 * total


def control_chart(days: DataFrame, mean: float, scale: float, alpha: float = 0.3, leak: float = 0.9, slack: float = 0.5) -> DataFrame:
    """The leaky control chart over dense daily slots (site, day, value or null)."""

    def step(state, row):
        site, day, value = row
        state, score = control_step(state, value, mean, scale, alpha, leak, slack)
        return state, (site, day, state["ewma"], state["cusum"], score)

    return ordered_scan(days.select("site", "day", F.col("value").cast("double").alias("value")), "site", ("day",), step, "site long, day date, ewma double, cusum double, score double")


def onset_labels(slots: DataFrame, marked: DataFrame, horizon: int) -> DataFrame:
    """Labels and first-onset exposure of every slot as issue, from onset intervals (lower, upper].

    slots: site, day, usable; marked: the result of onsets() for them. An onset surely inside
    (issue, issue + horizon] is positive; one whose interval straddles a boundary is
    ambiguous; without either the future must be covered to be negative. Lower bounds grow
    with upper ones, so the next onset after a frame is the only one that can reach into it.
    """
    by_day = Window.partitionBy("site").orderBy("day")
    ahead, beyond = by_day.rowsBetween(1, horizon), by_day.rowsBetween(horizon + 1, Window.unboundedFollowing)
    later = by_day.rowsBetween(1, Window.unboundedFollowing)
    r = marked.join(slots.select("site", "day", "usable"), ["site", "day"])
    r = r.withColumns({"on": F.when(F.col("is_onset"), F.struct(F.col("day").alias("upper"), F.coalesce("onset_lower", F.lit("0001-01-01").cast("date")).alias("lower")))})
    r = r.withColumns({
        "surest": F.max("on.lower").over(ahead), "doubtful": F.min("on.lower").over(ahead), "next_on": F.first("on", ignorenulls=True).over(beyond),
        "first_on": F.first("on", ignorenulls=True).over(later), "covered": F.sum(F.col("usable").cast("long")).over(by_day.rowsBetween(0, horizon)),
    })
    straddles = F.coalesce(F.col("doubtful") < F.col("day"), F.lit(False)) | F.coalesce(F.col("next_on.lower") < F.date_add("day", horizon), F.lit(False))
    known = F.coalesce((F.col("class") == "L") & F.col("at_risk"), F.lit(False))
    reason = (
        F.when(~known, "current_state_unknown_or_ongoing").when(F.col("surest") >= F.col("day"), "definite_future_onset")
        .when(straddles, "onset_boundary_ambiguous").when(F.col("covered") <= horizon, "incomplete_future_monitoring").otherwise("complete_sampled_future_monitoring")
    )
    bounded = F.col("first_on.lower") >= F.col("day")
    return r.withColumn("reason", reason).select(
        "site", F.col("day").alias("issue"), "reason", F.when(F.col("reason") == "definite_future_onset", 1).when(F.col("reason") == "complete_sampled_future_monitoring", 0).alias("label"),
        F.when(F.col("first_on").isNull(), "no_future_onset").when(bounded, "bounded_interval").otherwise("unknown_interval_may_precede_issue").alias("first_status"),
        F.when(bounded, 24 * F.datediff("first_on.lower", "day")).cast("long").alias("lead_lower"), F.when(bounded, 24 * F.datediff("first_on.upper", "day")).cast("long").alias("lead_upper"),
    )


def causal_filter(rows: DataFrame, taps: Sequence[float], dilation: int = 1) -> DataFrame:
    """Causal dilated filter of each site's values: sum of tap k times the value k * dilation steps before, zero before the start."""
    w = Window.partitionBy("site").orderBy("t", "obs_id")
    total = sum(F.lit(float(c)) * F.lag(F.col("value").cast("double"), k * dilation, 0.0).over(w) if k else F.lit(float(c)) * F.col("value").cast("double") for k, c in enumerate(taps))
    return rows.withColumn("filtered", total)
