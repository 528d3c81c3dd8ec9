"""Isotonic regression of groups of any size: the lower convex hull of cumulated counts, merged from slices.

The nondecreasing rates nearest to pos / n by score are the slopes of the greatest convex
minorant of the points (cumulated n, cumulated pos). Points are cut by range into slices.
Each slice keeps its own hull; then the two first and two last hull points of every slice
make a reduced chain. If that is convex, so is the whole. Otherwise its hull lies below
points of the slices, which are dropped, and what is left is sliced anew. Pooling that goes
on over many slices thus takes one round, not one a slice. A task holds one slice, or four
points of each slice of a group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import written

#: Distinct scores, or hull points, of a slice.
SLICE_ROWS = 100_000

Point = tuple[int, int]


def lower_hull(xs: list[int], ys: list[int]) -> list[int]:
    """Places of the points on the lower convex hull of points ascending by x, without those on its edges; exact integers."""
    kept: list[int] = []
    for i in range(len(xs)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (ys[b] - ys[a]) * (xs[i] - xs[b]) < (ys[i] - ys[b]) * (xs[b] - xs[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


def _hulls(points: DataFrame, key: str) -> DataFrame:
    """Each slice's hull points of points (key, slice, x, y, home)."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pdf.iloc[lower_hull(pdf["x"].tolist(), pdf["y"].tolist())]

    return points.groupBy(key, "slice").applyInPandas(hull, points.schema)


def _sliced(points: DataFrame, key: str, order: str, n: int, slice_rows: int) -> DataFrame:
    parts = max(1, -(-n // slice_rows))
    return points.repartitionByRange(parts, key, order).withColumn("slice", F.spark_partition_id())


def hull_points(points: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The lower hull of each key's points (key, x, y, home), as a written table; home is carried along."""
    at = written(points, "points")
    while True:
        own = written(_hulls(_sliced(at, key, "x", at.count(), slice_rows), key), "hulls")
        # the two first and last points of each slice, a few rows a slice
        low, high = Window.partitionBy(key, "slice").orderBy("x"), Window.partitionBy(key, "slice").orderBy(F.desc("x"))
        ends = own.withColumns({"first": F.row_number().over(low), "last": F.row_number().over(high)}).filter("first <= 2 or last <= 2").drop("first", "last")

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            """For each slice the points of the reduced chain's hull from before it to behind it, where the chain is not convex."""
            pdf = pdf.sort_values("x")
            xs, ys = pdf["x"].tolist(), pdf["y"].tolist()
            kept = lower_hull(xs, ys)
            if len(kept) == len(xs):
                return pd.DataFrame([], columns=[key, "slice", "hx", "hy"], dtype=object)
            hx, hy = [xs[i] for i in kept], [ys[i] for i in kept]
            out = []
            for number, some in pdf.groupby("slice")["x"]:
                a = max([i for i, x in enumerate(hx) if x <= some.min()] or [0])
                b = min([i for i, x in enumerate(hx) if x >= some.max()] or [len(hx) - 1])
                out.append((pdf[key].iloc[0], number, hx[a : b + 1], hy[a : b + 1]))
            return pd.DataFrame(out, columns=[key, "slice", "hx", "hy"])

        of = f"{key} {own.schema[key].dataType.simpleString()}, slice int, hx array<long>, hy array<long>"
        below = written(ends.groupBy(key).applyInPandas(chain, of), "chains")
        if below.isEmpty():
            return own.drop("slice")

        def under(mine: pd.DataFrame, chains: pd.DataFrame) -> pd.DataFrame:
            """The slice's points that are not above the chain's hull."""
            if not len(chains):
                return mine
            mine = mine.sort_values("x")
            hx, hy = list(map(int, chains["hx"].iloc[0])), list(map(int, chains["hy"].iloc[0]))
            keep, j = [], 0
            for x, y in zip(mine["x"].tolist(), mine["y"].tolist(), strict=True):
                while j + 2 < len(hx) and hx[j + 1] <= x:
                    j += 1
                if len(hx) < 2 or x in (hx[j], hx[j + 1]):
                    keep.append(True if len(hx) < 2 else (x, y) in ((hx[j], hy[j]), (hx[j + 1], hy[j + 1])))
                else:
                    keep.append((y - hy[j]) * (hx[j + 1] - hx[j]) < (hy[j + 1] - hy[j]) * (x - hx[j]))
            return mine[keep]

        at = written(own.groupBy(key, "slice").cogroup(below.groupBy(key, "slice")).applyInPandas(under, own.schema).drop("slice"), "points")


def isotonic(counts: DataFrame, key: str, score: str = "k", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, score, fitted) of counts (key, score, pos, neg), one row each distinct score.

    A null key is a group of its own. No task holds more than a slice of a key's scores.
    """
    kept = written(counts.select(key, score, "pos", (F.col("pos") + F.col("neg")).cast("long").alias("n")), "counts")
    sliced = written(_sliced(kept, key, score, kept.count(), slice_rows), "score_slices")
    sums = sliced.groupBy(key, "slice").agg(F.sum("n").alias("sum_n"), F.sum("pos").alias("sum_pos"))
    by_slice = Window.partitionBy(key).orderBy("slice")  # a row a slice
    offsets = written(sums.select(F.col(key).alias("__key"), F.col("slice").alias("__slice"), *[(F.sum(c).over(by_slice) - F.col(c)).cast("long").alias(a) for c, a in (("sum_n", "x0"), ("sum_pos", "y0"))]), "offsets")
    here = sliced[key].eqNullSafe(F.col("__key")) & (F.col("slice") == F.col("__slice"))
    placed = sliced.join(offsets, here).drop("__key", "__slice")

    def cumulated(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(score)
        return pd.DataFrame({key: pdf[key], "x": pdf["x0"] + pdf["n"].cumsum(), "y": pdf["y0"] + pdf["pos"].cumsum(), "home": pdf["slice"]})

    kind = counts.schema[key].dataType.simpleString()
    points = placed.groupBy(key, "slice").applyInPandas(cumulated, f"{key} {kind}, x long, y long, home int")
    origin = offsets.select(F.col("__key").alias(key)).distinct().select(key, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).alias("home"))
    hull = hull_points(points.unionByName(origin), key, slice_rows)
    # hull points by the slice they come from, and for each slice the last one before it and the first one behind it
    own = hull.groupBy(key, F.col("home").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("own"))
    every = offsets.select(F.col("__key").alias(key), F.col("__slice").alias("slice")).unionByName(origin.select(key, F.col("home").alias("slice")))
    met = every.join(own.withColumnsRenamed({key: "__key", "slice": "__slice"}), every[key].eqNullSafe(F.col("__key")) & (F.col("slice") == F.col("__slice")), "left").drop("__key", "__slice")
    before = F.last(F.element_at("own", -1), ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(F.element_at("own", 1), ignorenulls=True).over(by_slice.rowsBetween(1, Window.unboundedFollowing))
    around = met.withColumns({"before": before, "behind": behind}).select(key, "slice", F.array_compact(F.concat(F.array("before"), F.coalesce("own", F.array().cast("array<struct<x:bigint,y:bigint>>")), F.array("behind"))).alias("chain"))

    def slopes(mine: pd.DataFrame, chains: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame([], columns=[key, score, "fitted"], dtype=object)
        mine = mine.sort_values(score)
        chain = [(int(p["x"]), int(p["y"])) for p in chains["chain"].iloc[0]]
        fitted, j = [], 0
        for x in (mine["x0"] + mine["n"].cumsum()).tolist():
            while chain[j + 1][0] < x:
                j += 1
            (xa, ya), (xb, yb) = chain[j], chain[j + 1]
            fitted.append((yb - ya) / (xb - xa))
        return pd.DataFrame({key: mine[key], score: mine[score], "fitted": fitted})

    return placed.groupBy(key, "slice").cogroup(around.groupBy(key, "slice")).applyInPandas(slopes, f"{key} {kind}, {score} {counts.schema[score].dataType.simpleString()}, fitted double")
