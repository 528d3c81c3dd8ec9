"""Statistics of windows relative to their own past: tabular features, reference support, paired contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.daily import usable
from tidemark.operators.fitting import with_t_critical

#: Pairs whose sign flips are all told: 2^16 sums a group.
EXACT_PAIRS = 16


def tabular_features(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Six figures of the stage and four of the flow of each window, relative to its first observation.

    rows: keys, order, channel (stage or flow) and value (null where not observed). A
    channel of one observation or none has zeros. Spread is that of the population.
    """
    at, x = F.struct(*order), F.col("value").cast("double")

    def of(channel: str) -> dict[str, Column]:
        here = (F.col("channel") == channel) & F.col("value").isNotNull()
        v = F.when(here, x)
        first, last = F.min_by(v, F.when(here, at)), F.max_by(v, F.when(here, at))
        figures = {"delta": last - first, "std": F.stddev_pop(v), "min": F.min(v) - first, "max": F.max(v) - first, "range": F.max(v) - F.min(v), "latest": last - F.avg(v)}
        some = figures if channel == "stage" else {k: figures[k] for k in ("delta", "std", "range", "latest")}
        return {f"{channel}_{k}": F.when(F.count(v) > 1, c).otherwise(F.lit(0.0)) for k, c in some.items()}

    return rows.groupBy(*keys).agg(*[c.alias(n) for channel in ("stage", "flow") for n, c in of(channel).items()])


def reference_support(days: DataFrame, start: str, end: str, lanes: Sequence[str] = ("primary", "unflagged")) -> DataFrame:
    """(site, ref_lane, year, n_usable, ...) for every year of the half-open reference window, and whether all of them have support."""
    spark = days.sparkSession
    refs = days.filter((F.col("local_date") >= F.lit(start).cast("date")) & (F.col("local_date") < F.lit(end).cast("date")))
    lane = F.broadcast(spark.createDataFrame([(x,) for x in lanes], "ref_lane string"))
    years = F.explode(F.sequence(F.year(F.lit(start).cast("date")), F.year(F.date_sub(F.lit(end).cast("date"), 1)))).alias("year")
    by_year = refs.crossJoin(lane).groupBy("site", "ref_lane", F.year("local_date").alias("year")).agg(
        F.count_if(usable(F.col("ref_lane"))).alias("n_usable"), F.count_if(F.col("quality") == "approved_unflagged").alias("n_unflagged"),
        F.count_if(F.col("quality") == "estimated_flagged").alias("n_estimated"), F.count_if(~usable(F.col("ref_lane"))).alias("n_unusable"),
    )
    every = days.select("site").distinct().crossJoin(lane).select("site", "ref_lane", years)
    dense = every.join(by_year, ["site", "ref_lane", "year"], "left").fillna(0, ["n_usable", "n_unflagged", "n_estimated", "n_unusable"])
    whole = dense.groupBy("site", "ref_lane").agg(F.bool_and(F.col("n_usable") > 0).alias("all_years_supported"))
    return dense.join(whole, ["site", "ref_lane"])


def paired_contrast(diffs: DataFrame, key: str, confidence: float = 0.95) -> DataFrame:
    """(key, n, mean_d, sd_d, se_d, dz, ci_low, ci_high, p_value, decision) of each key's paired differences d.

    The p-value is that of all sign flips; a key of one pair or of more than EXACT_PAIRS
    raises. Without spread the interval is the mean and dz NULL. The decision needs both
    the p-value and the interval.
    """
    d = F.col("d")
    sums = diffs.groupBy(key).agg(F.count(d).alias("n"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd_d"), F.slice(F.collect_list(d), 1, EXACT_PAIRS + 1).alias("ds"))
    fits = F.when(F.col("n").between(2, EXACT_PAIRS), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("pairs of a contrast: "), F.col("n").cast("string"))).cast("long"))
    sums = with_t_critical(sums.withColumn("n", fits).withColumn("df", F.col("n") - 1), "df", confidence).drop("df")
    sums = sums.withColumns({"se_d": F.col("sd_d") / F.sqrt("n"), "spread": F.col("sd_d") > 1e-12})
    reach = F.when(F.col("spread"), F.col("critical") * F.col("se_d")).otherwise(F.lit(0.0))
    masks = sums.select(key, "ds", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("ds")) - 1)).alias("mask"))
    flipped = F.aggregate(
        F.zip_with("ds", F.sequence(F.lit(0), F.size("ds") - 1), lambda x, i: F.when(F.getbit(F.col("mask"), i) == 1, -x).otherwise(x)),
        F.lit(0.0), lambda a, x: a + x,
    )
    seen = F.abs(F.aggregate("ds", F.lit(0.0), lambda a, x: a + x))
    p = masks.groupBy(F.col(key).alias("__key")).agg((F.count_if(F.abs(flipped) >= seen - 1e-12) / F.count("*")).alias("p_value"))
    out = sums.join(p, F.col(key).eqNullSafe(F.col("__key")))
    out = out.withColumns({"ci_low": F.col("mean_d") - reach, "ci_high": F.col("mean_d") + reach, "dz": F.when(F.col("spread"), F.col("mean_d") / F.col("sd_d"))})
    decided = F.when(F.col("p_value") > 1 - confidence, "inconclusive").when(F.col("ci_low") > 0, "superiority").when(F.col("ci_high") < 0, "inferiority").otherwise("inconclusive")
    return out.select(key, "n", "mean_d", "sd_d", "se_d", "dz", "ci_low", "ci_high", "p_value", decided.alias("decision"))
