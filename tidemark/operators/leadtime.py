"""Alerts against events: greedy one-to-one matching inside a horizon, and lead-time summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.operators import quantiles
from tidemark.operators.series import HOUR, ordered_scan


def match(alerts: DataFrame, events: DataFrame, horizon_hours: float) -> DataFrame:
    """Match each alert (site, t, obs_id), in time order, to the unmatched event with the smallest lower lead.

    events: site, event_id, onset_lower, onset_upper (microseconds); those without a lower
    bound are dropped. An event is eligible if its upper or lower bound lies 0 to horizon
    hours ahead. Both tables are one stream by site and time: an event enters when its
    horizon opens and leaves when its onset is past, so memory holds the open ones.
    """
    span = int(horizon_hours * HOUR)
    none = F.lit(None).cast("long")
    a = alerts.select("site", "t", F.lit(1).alias("is_alert"), F.col("obs_id").alias("id"), none.alias("lower"), none.alias("upper"))
    e = events.filter("onset_lower is not null").select("site", (F.col("onset_lower") - span).alias("t"), F.lit(0).alias("is_alert"), F.col("event_id").alias("id"), F.col("onset_lower").alias("lower"), F.col("onset_upper").alias("upper"))

    def step(state, row):
        site, t, is_alert, ident, lower, upper = row
        state = state or {"open": []}
        if not is_alert:
            state["open"].append((int(lower), int(ident), int(upper)))
            return state, None
        state["open"] = [x for x in state["open"] if x[2] >= t]
        fit = [x for x in state["open"] if 0 <= x[2] - t <= span or 0 <= x[0] - t <= span]
        if not fit:
            return state, (site, ident, t, None, None, None)
        best = min(fit)
        state["open"].remove(best)
        return state, (site, ident, t, best[1], (best[0] - t) / HOUR, (best[2] - t) / HOUR)

    schema = "site long, obs_id long, t long, event_id long, lead_lower double, lead_upper double"
    return ordered_scan(a.unionByName(e), "site", ("t", "is_alert", "id"), step, schema)


def summary(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Recall, false-alert share and leads over all sites; recall without events is 0."""
    mid = (F.col("lead_lower") + F.col("lead_upper")) / 2
    matches = written(matches, "matches")
    median = quantiles.quantiles(matches.select(mid.alias("lead")), [], "lead", [0.5]).select(F.col("q")[0].alias("median_lead"))
    m = matches.agg(F.count("*").alias("n_alerts"), F.count("event_id").alias("n_matched"), F.avg(mid).alias("mean_lead"), F.min(mid).alias("min_lead"), F.max(mid).alias("max_lead"))
    n = events.agg(F.count("*").alias("n_events"))
    out = m.crossJoin(F.broadcast(n)).join(F.broadcast(median), F.lit(True), "left")  # a row each
    return out.withColumns({"recall": F.when(F.col("n_events") > 0, F.col("n_matched") / F.col("n_events")).otherwise(F.lit(0.0)), "false_alert_rate": F.when(F.col("n_alerts") > 0, 1 - F.col("n_matched") / F.col("n_alerts")).otherwise(F.lit(0.0))})


def by_category(matches: DataFrame, events: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(category, n_events, n_detected, recall, leads) of every named category, also those without events, whose recall is 0."""
    mid = (F.col("lead_lower") + F.col("lead_upper")) / 2
    found = matches.filter("event_id is not null").select("site", "event_id", mid.alias("lead"), F.lit(True).alias("hit"))
    named = events.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    met = named.join(events.join(found, ["site", "event_id"], "left"), "category", "left")
    met = written(met, "leads")
    medians = quantiles.quantiles(met, ["category"], "lead", [0.5]).select(F.col("category").alias("of"), F.col("q")[0].alias("median_lead"))
    out = met.groupBy("category").agg(
        F.count("event_id").alias("n_events"), F.count("hit").alias("n_detected"), F.avg("lead").alias("mean_lead"),
        F.min("lead").alias("min_lead"), F.max("lead").alias("max_lead"),
    ).join(F.broadcast(medians), F.col("category") == F.col("of"), "left").drop("of")
    return out.withColumn("recall", F.when(F.col("n_events") > 0, F.col("n_detected") / F.col("n_events")).otherwise(F.lit(0.0)))
