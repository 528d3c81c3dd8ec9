"""Guards raise on planted faults; contrasts and features against numpy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tidemark.operators import guards, windows

OBS = "record_id long, basis string, t_end long, t_available long"
ROWS = "record_id long, site string, series string, t long, value double"


@pytest.mark.parametrize(("bad", "allow"), [((9, "unknown", 1, 2), True), ((9, "other", 1, 2), True), ((9, None, 1, 2), True), ((9, "assumed", 1, 2), False), ((9, "measured", 1, None), True), ((9, "measured", 5, 4), True), ((1, "measured", 1, 2), True), ((None, "measured", 1, 2), True)])
def test_unverified_availability_raises(spark, bad, allow):
    good = [(1, "measured", 1, 1), (2, "measured", 1, 9)]
    assert guards.admissible(spark.createDataFrame(good, OBS)).count() == 2
    with pytest.raises(Exception, match="availability is unverified|record id is missing or repeated"):
        guards.admissible(spark.createDataFrame([*good, bad], OBS), allow).collect()


def test_unique_rows(spark):
    rows = [(1, "a", "x", 5, 1.0), (1, "a", "x", 5, 1.0), (2, "a", "x", 6, None), (2, "a", "x", 6, None), (3, "b", None, 5, 1.0)]
    key = ["site", "series", "t"]
    assert sorted(r.record_id for r in guards.unique_rows(spark.createDataFrame(rows, ROWS), key).collect()) == [1, 2, 3]
    for bad, message, kind in (((1, "a", "x", 5, 2.0), "conflicting rows", "conflicting_rows"), ((7, "a", "x", 5, 1.0), "several versions", "several_versions")):
        df = spark.createDataFrame([*rows, bad], ROWS)
        with pytest.raises(Exception, match=message):
            guards.unique_rows(df, key).collect()
        assert kind in {r.kind for r in guards.version_conflicts(df, key).collect()}


def test_network_is_refused(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,), (3,)], "node long"), spark.createDataFrame([(1, 2)], "a long, b long")
    assert {(r.node, r.root) for r in guards.network_components(nodes, edges, topology_verified=True).collect()} == {(1, 1), (2, 1), (3, 3)}
    with pytest.raises(ValueError, match="not verified"):
        guards.network_components(nodes, edges, topology_verified=False)
    with pytest.raises(Exception, match="unknown node"):
        guards.network_components(nodes, spark.createDataFrame([(1, 9)], "a long, b long"), topology_verified=True).collect()


def test_contrasts(spark):
    rng = random.Random(3)
    groups = {"plus": [rng.uniform(0.1, 1) for _ in range(9)], "minus": [-rng.uniform(0.1, 1) for _ in range(8)], "none": [rng.uniform(-1, 1) for _ in range(7)], "flat": [0.25] * 6, "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, d) for k, ds in groups.items() for d in ds], "k string, d double")
    t = {8: 2.306004135204166, 7: 2.3646242515927844, 6: 2.4469118511449692, 5: 2.570581835636314, 1: 12.706204736432095}
    for r in windows.paired_contrast(df, "k").collect():
        ds = np.array(groups[r.k])
        flips = [abs(sum(s * d for s, d in zip(signs, ds, strict=True))) for signs in itertools.product((1, -1), repeat=len(ds))]
        assert r.p_value == pytest.approx(np.mean(np.array(flips) >= abs(ds.sum()) - 1e-12))
        assert r.mean_d == pytest.approx(ds.mean()) and r.sd_d == pytest.approx(ds.std(ddof=1), abs=1e-12)
        reach = t[len(ds) - 1] * ds.std(ddof=1) / np.sqrt(len(ds)) if r.k != "flat" else 0.0
        assert (r.ci_low, r.ci_high) == (pytest.approx(ds.mean() - reach, abs=1e-6), pytest.approx(ds.mean() + reach, abs=1e-6))
        assert r.decision == {"plus": "superiority", "minus": "inferiority", "flat": "superiority"}.get(r.k, "inconclusive") and (r.dz is None) == (r.k == "flat")
    for n in (1, 17):
        with pytest.raises(Exception, match="pairs of a contrast"):
            windows.paired_contrast(spark.createDataFrame([("x", float(i)) for i in range(n)], "k string, d double"), "k").collect()


def test_tabular_features(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice(["stage", "flow"]), rng.choice([None, rng.uniform(0, 9), rng.uniform(0, 9)])) for k in range(6) for i in range(k * 3)] + [(9, 0, "stage", 1.0)]
    found = {r.k: r for r in windows.tabular_features(spark.createDataFrame(rows, "k int, i int, channel string, value double").repartition(3), ["k"], ["i"]).collect()}
    for k, r in found.items():
        for channel in ("stage", "flow"):
            v = np.array([x for kk, _, c, x in sorted(rows, key=lambda y: y[1]) if kk == k and c == channel and x is not None])
            names = ("delta", "std", "min", "max", "range", "latest") if channel == "stage" else ("delta", "std", "range", "latest")
            figures = {"delta": v[-1] - v[0], "std": v.std(), "min": v.min() - v[0], "max": v.max() - v[0], "range": np.ptp(v), "latest": v[-1] - v.mean()} if len(v) > 1 else dict.fromkeys(names, 0.0)
            assert [r[f"{channel}_{n}"] for n in names] == pytest.approx([figures[n] for n in names])
