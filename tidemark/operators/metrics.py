"""Ranking, probability and calibration metrics over pre-grouped scores.

Each metric starts from counts of positives and negatives by score, which partial
aggregation makes before any shuffle; windows then run over distinct scores, not samples.
Undefined values (one class, no alerts) are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import written


def grouped(pred: DataFrame, keys: Sequence[str], score: str = "k") -> DataFrame:
    return pred.groupBy(*keys, score).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def ranking(g: DataFrame, keys: Sequence[str], score: str = "k") -> DataFrame:
    """AUROC (ties count half), average precision over tie groups, and the trapezoid under precision-recall from (0, 1)."""
    down = Window.partitionBy(*keys).orderBy(F.col(score).desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    r = g.withColumns({"tp": F.sum("pos").over(upto), "fp": F.sum("neg").over(upto), "np": F.sum("pos").over(whole), "nn": F.sum("neg").over(whole)})
    r = r.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "np")})
    r = r.withColumns({"p0": F.lag("precision", 1, 1.0).over(down), "r0": F.lag("recall", 1, 0.0).over(down)})
    return r.groupBy(*keys).agg(
        F.max("np").alias("n_pos"), F.max("nn").alias("n_neg"),
        F.try_divide(F.sum(F.col("pos") * (2 * (F.col("nn") - F.col("fp")) + F.col("neg"))).cast("double"), 2.0 * F.max("np") * F.max("nn")).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("np")).alias("ap"),
        F.when(F.max("np") > 0, F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2)).alias("pr_auc"),
    )


def mid_ranks(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """1-based ranks; tied scores share the mean of theirs. Windows run over distinct scores, not rows."""
    counts = df.groupBy(*keys, score).agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy(*keys).orderBy(score))
    ranks = counts.select(*keys, score, (upto - (F.col("ties") - 1) / 2).alias("mid_rank"))
    return df.join(ranks, [*keys, score])


def confusion(pred: DataFrame, keys: Sequence[str], alert: Column) -> DataFrame:
    """Counts and rates; precision and recall are NULL where undefined, F1 is then 0."""
    y = F.col("y") == 1
    c = pred.groupBy(*keys).agg(F.count_if(y & alert).alias("tp"), F.count_if(~y & alert).alias("fp"), F.count_if(y & ~alert).alias("fn"), F.count_if(~y & ~alert).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return c.withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": sens, "specificity": spec, "accuracy": (tp + tn) / (tp + fp + fn + tn),
        "balanced_accuracy": (sens + spec) / 2, "f1": F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0)),
    })


def probability(g: DataFrame, keys: Sequence[str], p: Column, clip: float = 1e-15) -> DataFrame:
    """Brier score with its reference and skill, log-loss clipped and exact (infinite if a sure forecast fails)."""
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    bad = ((p == 0) & (F.col("pos") > 0)) | ((p == 1) & (F.col("neg") > 0))
    n, pos = F.sum(F.col("pos") + F.col("neg")), F.sum("pos")
    part = g.groupBy(*keys).agg(
        n.alias("n"), (pos / n).alias("prevalence"), (F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / n).alias("brier"),
        (-F.sum(F.col("pos") * F.ln(q) + F.col("neg") * F.ln(1 - q)) / n).alias("log_loss"), F.bool_or(bad).alias("bad"),
    )
    ref = F.col("prevalence") * (1 - F.col("prevalence"))
    return part.withColumns({"brier_skill": 1 - F.try_divide(F.col("brier"), ref), "exact_is_infinite": F.col("bad")}).drop("bad")


def calibration(g: DataFrame, keys: Sequence[str], p: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins, the right edge of an inner bin belonging to the next: counts, mean forecast and observed rate."""
    edge = sum((p >= F.lit(i / bins)).cast("int") for i in range(1, bins))
    n = F.col("pos") + F.col("neg")
    b = g.withColumn("bin", edge).groupBy(*keys, "bin").agg(F.sum(n).alias("n"), (F.sum(n * p) / F.sum(n)).alias("confidence"), (F.sum("pos") / F.sum(n)).alias("observed"))
    return b.withColumn("gap", F.abs(F.col("confidence") - F.col("observed")))


def calibration_errors(b: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.sum("n")
    return b.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / n).alias("ece"), F.max("gap").alias("mce"), F.sqrt(F.sum(F.col("n") * F.col("gap") * F.col("gap")) / n).alias("rmsce"))


def murphy(g: DataFrame, keys: Sequence[str], p: Column) -> DataFrame:
    """Brier = reliability - resolution + uncertainty, by distinct forecast; skill is (res - rel) / unc."""
    n = F.col("pos") + F.col("neg")
    whole = Window.partitionBy(*keys)
    r = g.withColumns({"rate": F.sum("pos").over(whole) / F.sum(n).over(whole), "seen": F.col("pos") / n})
    out = r.groupBy(*keys).agg(
        (F.sum(n * (p - F.col("seen")) * (p - F.col("seen"))) / F.sum(n)).alias("reliability"),
        (F.sum(n * (F.col("seen") - F.col("rate")) * (F.col("seen") - F.col("rate"))) / F.sum(n)).alias("resolution"),
        F.max(F.col("rate") * (1 - F.col("rate"))).alias("uncertainty"),
    )
    return out.withColumn("skill", F.try_divide(F.col("resolution") - F.col("reliability"), F.col("uncertainty")))


def calibration_curve(g: DataFrame, keys: Sequence[str], p: Column, bins: int = 5, strategy: str = "uniform") -> DataFrame:
    """(keys, bin, low, high, n, confidence, observed) of equal-width or equal-count bins, empty ones with their middle and 0.

    Quantile edges that do not grow are set a millionth above the edge before.
    """
    n = F.col("pos") + F.col("neg")
    if strategy == "uniform":
        edges = g.select(*keys).distinct().withColumn("edges", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))
    else:
        cuts = F.percentile(p, F.array(*[F.lit(i / bins) for i in range(bins + 1)]), n)
        grown = F.aggregate("cuts", F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.when((F.size(a) > 0) & (x <= F.element_at(a, -1)), F.element_at(a, -1) + 1e-6).otherwise(x)))
        edges = g.groupBy(*keys).agg(cuts.alias("cuts")).select(*keys, grown.alias("edges"))
    at = sum(((p >= F.get("edges", F.lit(i))).cast("int") for i in range(1, bins)), F.lit(0))
    met = g.join(F.broadcast(edges) if not keys else edges, list(keys)).withColumn("bin", at)
    full = met.groupBy(*keys, "bin").agg(F.sum(n).alias("n"), (F.sum(n * p) / F.sum(n)).alias("confidence"), (F.sum("pos") / F.sum(n)).alias("observed"))
    every = edges.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low, high = F.get("edges", F.col("bin")), F.get("edges", F.col("bin") + 1)
    return every.join(full, [*keys, "bin"], "left").select(
        *keys, F.col("bin").cast("long").alias("bin"), low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce("confidence", (low + high) / 2).alias("confidence"), F.coalesce("observed", F.lit(0.0)).alias("observed"),
    )


def holm(df: DataFrame, key: str, p: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - rank + 1) p, at most 1.

    One family over all rows is cut into ranges of p: ranks and maxima run inside each
    range, and the ranges' counts and maxima are carried over.
    """
    if keys:
        order = Window.partitionBy(*keys).orderBy(p, key)
        m = F.count("*").over(Window.partitionBy(*keys))
        out = df.withColumn("raised", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
        out = out.withColumn("adjusted", F.max("raised").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("raised")
        return out.withColumn("rejected", F.col("adjusted") <= alpha)
    parts = written(df.repartitionByRange(p, key).withColumn("__part", F.spark_partition_id()), "holm")
    within = Window.partitionBy("__part").orderBy(p, key)
    local = parts.withColumn("__i", F.row_number().over(within))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__m"))
    raised = local.join(F.broadcast(starts), "__part").withColumn("__raised", F.least(F.lit(1.0), (F.col("__m") - F.col("__start") - F.col("__i") + 1) * F.col(p)))
    tops = raised.groupBy("__part").agg(F.max("__raised").alias("__top")).select("__part", F.max("__top").over(before).alias("__carried"))
    own = F.max("__raised").over(within.rowsBetween(Window.unboundedPreceding, 0))
    out = raised.withColumn("__own", own).join(F.broadcast(tops), "__part").withColumn("adjusted", F.greatest("__own", F.coalesce("__carried", F.lit(0.0))))
    return out.select(*df.columns, "adjusted").withColumn("rejected", F.col("adjusted") <= alpha)


def sign_flip(differences: DataFrame, most: int = 16, draws: int = 10_000, seed: int = 314_159, tolerance: float = 1e-12) -> DataFrame:
    """(n, p_value, is_exact): two-sided sign-flip p-value of paired differences (column d).

    Up to `most` pairs all sign patterns are tried. Beyond, `draws` patterns by a seeded hash
    of pair and draw are, as (extreme + 1) / (draws + 1); their sums are partially
    aggregated, so pairs are never gathered. No pairs, or none that differ, have p = 1.
    """
    paired = written(differences.select(F.col("d").cast("double").alias("d"), F.monotonically_increasing_id().alias("i")), "pairs")
    whole = paired.agg(F.count("d").alias("n"), F.coalesce(F.abs(F.sum("d")), F.lit(0.0)).alias("seen"), F.coalesce(F.max(F.abs("d")), F.lit(0.0)).alias("widest"))
    n = whole.first()["n"]
    if n <= most:
        packed = paired.agg(F.array_sort(F.collect_list("d")).alias("ds"))  # at most `most` numbers
        flips = packed.select("ds", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("mask"))
        total = F.aggregate(F.expr("transform(ds, (d, i) -> CASE WHEN (shiftright(mask, i) & 1) = 1 THEN -d ELSE d END)"), F.lit(0.0), lambda a, x: a + x)
        sums, extra = flips.select(F.abs(total).alias("t")), 0
    else:
        flips = paired.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "i", "draw"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        sums, extra = flips.groupBy("draw").agg(F.abs(F.sum(F.col("d") * sign)).alias("t")), 1
    extreme = F.count_if(F.col("t") >= F.col("seen") - tolerance)
    p = sums.crossJoin(F.broadcast(whole)).agg((extreme + extra) / (F.count("*") + extra), F.max("widest")).toDF("p", "widest")
    return p.select(F.lit(n).cast("long").alias("n"), F.when(F.col("widest") > 0, F.col("p")).otherwise(F.lit(1.0)).alias("p_value"), F.lit(n <= most).alias("is_exact"))
