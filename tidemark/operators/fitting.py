"""Fitted models over sufficient statistics: isotonic, Platt, ridge, covariance references.

Rows are reduced by Spark to what the fit needs (counts by score, sums of products), whose
size depends on scores and features, not on samples; the small fit follows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.operators import isotonic as by_slices


def pooled(score: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the nondecreasing rates nearest to pos / n, by score."""
    blocks: list[list[float]] = []
    for p, w in zip(pos[np.argsort(score)], n[np.argsort(score)], strict=True):
        blocks.append([float(p), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p1, w1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + w1, blocks[-1][2] + k1]
    fitted = np.concatenate([np.full(int(k), p / w) for p, w, k in blocks])
    out = np.empty(len(score))
    out[np.argsort(score)] = fitted
    return out


def isotonic(g: DataFrame, key: str, score: str = "k") -> DataFrame:
    """(key, score, fitted) from counts by score; a key's scores are fitted slice by slice."""
    return by_slices.isotonic(g, key, score)


def step_predict(scores: DataFrame, fitted: DataFrame, score: str = "k", value: str = "fitted", slice_rows: int = by_slices.SLICE_ROWS) -> DataFrame:
    """The fitted value of the rightmost threshold at or below each score; below all the first one.

    Thresholds and distinct scores are one sorted stream, cut by range into slices; a slice
    takes over the last threshold before it. Samples then meet their score's value.
    """
    marks = written(fitted.select("key", F.col(score).alias("s"), F.lit(0).alias("is_score"), F.col(value).alias("v")), "marks")
    asked = scores.select("key", F.col(score).alias("s")).distinct().select("key", "s", F.lit(1).alias("is_score"), F.lit(None).cast("double").alias("v"))
    both = written(marks.unionByName(asked), "steps")
    parts = max(1, -(-both.count() // slice_rows))
    sliced = written(both.repartitionByRange(parts, "key", "s", "is_score").withColumn("slice", F.spark_partition_id()), "step_slices")
    # what a slice takes over: a row a key and slice
    by_slice = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy("key", "slice").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.struct("s", "is_score"))).alias("end"))
    before = ends.select(F.col("key").alias("__key"), F.col("slice").alias("__slice"), F.last("end", ignorenulls=True).over(by_slice).alias("before"))
    first = marks.filter("v is not null").groupBy(F.col("key").alias("__first_key")).agg(F.min_by("v", F.struct("s", "is_score")).alias("first"))
    own = F.last("v", ignorenulls=True).over(Window.partitionBy("key", "slice").orderBy("s", "is_score").rowsBetween(Window.unboundedPreceding, 0))
    told = sliced.withColumn("own", own).filter("is_score = 1")
    told = told.join(before, F.col("key").eqNullSafe(F.col("__key")) & (F.col("slice") == F.col("__slice"))).join(first, F.col("key").eqNullSafe(F.col("__first_key")), "left")
    told = written(told.select(F.col("key").alias("__key"), F.col("s").alias("__s"), F.coalesce("own", "before", "first").alias("p")), "steps_told")
    met = scores.join(told, F.col("key").eqNullSafe(F.col("__key")) & F.col(score).eqNullSafe(F.col("__s")))
    return met.select("key", "id", score, "p")


def platt(g: DataFrame, key: str, steps: int = 200, rate: float = 0.05, l2: float = 0.1, least_weight: float = 0.01, clip: float = 25.0) -> DataFrame:
    """(key, w, b): logistic recalibration of a score p by gradient descent on counts by score (p, pos, neg)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        x, pos, n = pdf["p"].to_numpy(), pdf["pos"].to_numpy(float), (pdf["pos"] + pdf["neg"]).to_numpy(float)
        w, b = 1.0, 0.0
        for _ in range(steps):
            error = (n / (1 + np.exp(-np.clip(w * x + b, -clip, clip))) - pos) / n.sum()
            w, b = max(least_weight, w - rate * (float(error @ x) + l2 * w)), b - rate * float(error.sum())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "w": [w], "b": [b]})

    return g.groupBy(key).applyInPandas(fit, f"{key} {g.schema[key].dataType.simpleString()}, w double, b double")


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums and sums of products of the columns, by one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*"), *[F.sum(c) for c in columns], *[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).first()
    d = len(columns)
    products = np.zeros((d, d))
    for (i, j), x in zip(pairs, row[1 + d :], strict=True):
        products[i, j] = products[j, i] = x
    return row[0], np.array(row[1 : 1 + d], dtype=float), products


def ridge(df: DataFrame, columns: Sequence[str], target: str, l2: float, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights (last the intercept) of ridge regression by gradient descent; each step uses the moments alone."""
    n, sums, products = moments(df, [*columns, target])
    d = len(columns)
    gram = np.zeros((d + 1, d + 1))
    gram[:d, :d], gram[:d, d], gram[d, :d], gram[d, d] = products[:d, :d], sums[:d], sums[:d], n
    cross = np.append(products[:d, d], sums[d])
    w, shrink = np.zeros(d + 1), np.append(np.full(d, l2), 0.0)
    for _ in range(steps):
        w -= rate * ((gram @ w - cross) / n + shrink * w)
    return w


def covariance_reference(vectors: DataFrame, column: str, shrinkage: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and Cholesky factor of the shrunk covariance, from per-partition moments (d x d numbers each)."""
    schema = "n long, s array<double>, xx array<double>"

    def partial(batches: Any) -> Any:
        n, s, xx = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[column].to_numpy()).astype(float)
                n, s, xx = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if xx is None else xx)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "xx": [xx.ravel().tolist()]})

    parts = written(vectors.select(column).mapInPandas(partial, schema), "moments")
    # array sums by position, so that what comes back is one set of moments
    s = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    xx = parts.select(F.posexplode("xx").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    n = parts.agg(F.sum("n")).first()[0]
    mean = np.array([r["x"] for r in s]) / n
    d = len(mean)
    cov = (np.array([r["x"] for r in xx]).reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
    return mean, np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d))


def mahalanobis(vectors: DataFrame, key: str, column: str, mean: np.ndarray, factor: np.ndarray) -> DataFrame:
    """Squared distances by batches; the reference is d x d numbers."""
    inverse = np.linalg.inv(factor)

    def score(batches: Any) -> Any:
        for batch in batches:
            white = (np.stack(batch[column].to_numpy()).astype(float) - mean) @ inverse.T if len(batch) else np.zeros((0, len(mean)))
            yield pd.DataFrame({key: batch[key], "distance": (white**2).sum(axis=1)})

    return vectors.select(key, column).mapInPandas(score, f"{key} long, distance double")


def t_critical(confidence: float, df: int) -> float:
    """Two-sided Student-t critical value by bisection over the distribution function (numeric integral)."""

    def upper(t: float) -> float:
        u = np.linspace(0.0, np.pi / 2 - np.arctan(t / np.sqrt(df)), 20_001)
        f = np.sin(u) ** (df - 1)
        whole = np.sin(np.linspace(0.0, np.pi / 2, 20_001)) ** (df - 1)
        return float(np.trapezoid(f, u) / (2 * np.trapezoid(whole, np.linspace(0.0, np.pi / 2, 20_001))))

    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if upper(middle) > (1 - confidence) / 2 else (low, middle)
    return (low + high) / 2


def with_t_critical(rows: DataFrame, df: str, confidence: float) -> DataFrame:
    """rows with `critical`, the two-sided Student-t value of each row's degrees of freedom (NULL below 1); each degree is solved once a batch."""

    @F.pandas_udf("double")
    def critical(n: pd.Series) -> pd.Series:
        found = {k: t_critical(confidence, int(k)) for k in n.dropna().unique() if k >= 1}
        return n.map(found)

    return rows.withColumn("critical", critical(F.col(df)))


def control_reference(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, scale): mean and population spread of the finite values; a constant reference raises."""
    x = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    out = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("a constant reference has no scale")).cast("double")))


def cluster_bootstrap(means: DataFrame, draws: int, seed: int) -> DataFrame:
    """Percentile interval of the mean of clusters (cluster, value): each draw weighs clusters by hash-seeded Poisson(1) counts.

    Rows are draws x clusters and are aggregated by draw at once, without gathering clusters.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "cluster", "draw"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    k, cumulative, count = 1.0, 0.0, F.lit(0)
    for i in range(12):
        k = k / i if i else float(np.exp(-1.0))
        cumulative += k
        count = count + (u > cumulative).cast("int")
    drawn = means.select("cluster", "value", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("w", count)
    each = drawn.groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    return each.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("m").alias("n_draws"))
