"""Quantiles by selection and isotonic fits by slices, against plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitting, isotonic, quantiles

FRACTIONS = [0.0, 0.25, 0.5, 0.95, 1.0]


def shapes() -> dict[str | None, list[float | None]]:
    rng = random.Random(1)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(700)], "tenths": [rng.randint(0, 9) / 10 for _ in range(900)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(800)],
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 500, "tail": [0.0] * 600 + [1e308, -1e308, 1e-310, 5e-324], None: [rng.gauss(0, 1) for _ in range(300)] + [None] * 5,
        "mass": [1.0] * 400 + [2.0] * 400 + [rng.random() for _ in range(50)], "infinite": [-math.inf, *[float(i) for i in range(200)], math.inf, math.inf],
    }


@pytest.mark.parametrize(("small", "buckets"), [(10_000, 256), (5, 4), (1, 16)])
def test_quantiles(spark, small, buckets):
    rows = [(k, v) for k, values in shapes().items() for v in values] + [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    found = {r.g: (r.n, r.q) for r in quantiles.quantiles(df, ["g"], "x", FRACTIONS, small, buckets).collect()}
    assert set(found) == set(shapes())
    for k, values in shapes().items():
        known = [v for v in values if v is not None]
        assert found[k][0] == len(known)
        expected = np.quantile(np.array(known), FRACTIONS)
        ordered = sorted(known)
        for f, q, e in zip(FRACTIONS, found[k][1], expected, strict=True):
            p = f * (len(ordered) - 1)
            low, high = ordered[math.floor(p)], ordered[math.ceil(p)]
            plain = low if math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high
            assert q == plain or q == pytest.approx(e, rel=1e-9)


def test_quantiles_of_one_group_of_all_rows(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    row = quantiles.quantiles(df, [], "x", [0.5, 0.9], small=50).first()
    known = np.sort((np.arange(200_000) * 7919) % 200_003)
    assert row.n == 200_000 and row.q == pytest.approx(np.quantile(known, [0.5, 0.9]).tolist(), rel=1e-12)
    assert quantiles.quantiles(df.limit(0), [], "x", [0.5]).count() == 0


def curves() -> dict[str | None, list[tuple[float, int, int]]]:
    rng = random.Random(6)
    n = 400
    return {
        "noise": [(i / 7, int(rng.random() < 0.5), 1) for i in range(n)], "rising": [(float(i), i, n) for i in range(n)], "falling": [(float(i), n - i, n) for i in range(n)],
        "cascade": [(float(i), i, n) for i in range(n)] + [(1e6, 0, 10**9)], "head": [(-1.0, 10**9, 10**9)] + [(float(i), i, n) for i in range(n)], "one": [(0.5, 1, 3)],
        None: [(i / 3, int(rng.random() < i / n), 1) for i in range(n)], "zeros": [(float(i), 0, 1) for i in range(50)],
    }


@pytest.mark.parametrize("slice_rows", [100_000, 60, 7])
def test_isotonic_by_slices(spark, slice_rows):
    rows = [(k, s, p, n - p) for k, some in curves().items() for s, p, n in some]
    random.Random(2).shuffle(rows)
    counts = spark.createDataFrame(rows, "g string, k double, pos long, neg long")
    found = {(r.g, r.k): r.fitted for r in isotonic.isotonic(counts, "g", "k", slice_rows).collect()}
    assert len(found) == len(rows)
    for k, some in curves().items():
        s, p, n = (np.array(x, dtype=float) for x in zip(*some, strict=True))
        for score, fitted in zip(s, fitting.pooled(s, p, n), strict=True):
            assert found[k, score] == pytest.approx(fitted, abs=1e-9)
    assert isotonic.isotonic(counts.limit(0), "g").count() == 0
