"""Provider bodies, whole audits, curves, draws and ranks: hand cases and plain Python."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, cohorts, fitting, leadtime, metrics
from tidemark.sources import providers

COHORT = "sample_id string, label string, group_id string, split string, source_ids string"


def sound_cohort() -> list[tuple]:
    out = []
    for i, split in enumerate(("train", "validation", "test")):
        for k in range(4):
            out.append((f"s{i}{k}", str(k % 2), f"g{i}{k}", split, f"r{i}{k}|q{i}{k}"))
    return out


def audit(spark, rows, records=None) -> dict:
    known = records or [x for r in rows for x in (r[4] or "").split("|")]
    out = cohorts.cohort_audit(spark.createDataFrame(rows, COHORT), spark.createDataFrame([(x,) for x in known], "record_id string"))
    return {r.check: r.n for r in out.collect() if r.n}


def test_cohort_audit(spark):
    rows = sound_cohort()
    assert audit(spark, rows) == {}
    change = lambda i, **v: [tuple(v.get(c, x) for c, x in zip(("sample_id", "label", "group_id", "split", "source_ids"), r)) if k == i else r for k, r in enumerate(rows)]
    assert audit(spark, change(0, sample_id="s01")) == {"sample_id_empty_or_repeated": 1}
    assert audit(spark, change(0, label="2")) == {"label_invalid": 1, "class_floor": 1}
    assert audit(spark, change(0, split="dev")) == {"split_invalid": 1, "class_floor": 1}
    assert audit(spark, change(0, group_id=None)) == {"group_missing": 1}
    assert audit(spark, change(0, group_id="g10")) == {"group_leakage": 1}
    assert audit(spark, change(0, source_ids="r10|q00")) == {"source_leakage": 1}
    assert audit(spark, rows, ["r00"])["phantom_sources"] == 23
    assert audit(spark, [r for r in rows if r[3] != "test"]) == {"class_floor": 2, "test_group_floor": 1}


def test_causality_reasons(spark):
    issue, h = dt.datetime(2024, 1, 15, 12), dt.timedelta(hours=1)
    good = ("a", issue - 2 * h, issue - h, issue - h, "observed", "flow")
    cases = {
        None: good, "interval_missing": ("b", None, issue - h, issue, "observed", "flow"), "interval_inverted": ("c", issue, issue - h, issue, "observed", "flow"),
        "release_evidence_missing": ("d", issue - 2 * h, issue - h, issue, "assumed", "flow"), "release_time_missing": ("e", issue - 2 * h, issue - h, None, "observed", "flow"),
        "observed_after_issue": ("f", issue, issue + h, issue + h, "observed", "flow"), "before_lookback": ("g", issue - 26 * h, issue - 24.5 * h, issue, "observed", "flow"),
        "released_before_closure": ("h", issue - 2 * h, issue - h, issue - 2 * h, "observed", "flow"), "released_after_issue": ("i", issue - 2 * h, issue - h, issue + h, "observed", "flow"),
    }
    rows = [("s", *r) for r in cases.values()] + [("t", "j", issue - 26 * h, issue - 24.25 * h, issue, "observed", "flow"), ("t", "k", issue - 90 * h, issue - 80 * h, issue, "observed", "flood_stage_minor_m"), ("u", *good), ("u", *good)]
    df = spark.createDataFrame(rows, "sample string, record_id string, start timestamp_ntz, end timestamp_ntz, available timestamp_ntz, basis string, parameter string")
    out = {(r.sample, r.reason): r.n for r in cohorts.causality(df, "sample", F.lit(issue).cast("timestamp_ntz"), 24).collect()}
    assert out == {**{("s", k): 1 for k in cases}, ("t", None): 2, ("u", "record_repeated"): 2}
    assumed = cohorts.causality(df.filter("record_id = 'd'"), "sample", F.lit(issue).cast("timestamp_ntz"), 24, allow_assumed=True)
    assert assumed.first().reason is None


def test_bodies(spark):
    bodies = lambda *x: spark.createDataFrame([(1, json.dumps(b)) for b in x], "site long, body string")
    gauge = {"lid": "L1", "usgsId": None, "flood": {"categories": {"action": {"stage": 10}, "minor": {"stage": -1}, "major": {"stage": "x"}, "moderate": None}}}
    assert [tuple(r) for r in providers.gauge_stages(bodies(gauge)).collect()] == [("L1", "action", 3.048)]
    for bad in ({"flood": gauge["flood"]}, {"lid": "L", "flood": {"categories": {}}}, {"lid": "L"}):
        with pytest.raises(Exception, match="without identifier or categories"):
            providers.gauge_stages(bodies(bad)).collect()
    pixel = {"data": {"year": [2020, 2020], "yday": [60, 366], "prcp (mm/day)": [1.25, "nan"], "swe (kg/m^2)": [3]}}
    got = {(r.local_date, r.parameter): r.value for r in providers.pixel_days(bodies(pixel)).collect()}
    assert got == {(dt.date(2020, 2, 29), "precipitation_mm_day"): 1.25, (dt.date(2020, 2, 29), "snow_water_equivalent_kg_m2"): 3.0}
    with pytest.raises(Exception, match="aligned"):
        providers.pixel_days(bodies({"data": {"year": [2020], "yday": [1, 2]}})).collect()


def test_ledger_is_not_written_over(spark, tmp_path):
    rows = spark.range(3)
    providers.write_ledger(rows, f"{tmp_path}/ledger")
    with pytest.raises(Exception, match="(?i)exists"):
        providers.write_ledger(rows, f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 3


def test_bridge_refuses_unknown_sources(spark):
    samples = spark.createDataFrame([("a", "x|y")], "sample string, ids string")
    records = spark.createDataFrame([("x", 1), ("y", 2)], "record_id string, v int")
    assert {r.v for r in audits.bridged(samples, "ids", records, "record_id").collect()} == {1, 2}
    with pytest.raises(Exception, match="no record has source id y"):
        audits.bridged(samples, "ids", records.filter("v = 1"), "record_id").collect()


def test_sign_flips(spark):
    flip = lambda ds: metrics.sign_flip(spark.createDataFrame([(float(d),) for d in ds], "d double")).first()
    assert (flip([1, 2, 3, 4, 5]).p_value, flip([1, 2, 3, 4, 5]).is_exact) == (0.0625, True)
    assert flip([0, 0, 0]).p_value == 1.0
    rng = random.Random(3)
    ds = [rng.gauss(0.35, 1) for _ in range(40)]
    draws = np.random.default_rng(1).choice([-1.0, 1.0], size=(40_000, 40))
    wanted = float((np.abs(draws @ np.array(ds)) >= abs(sum(ds)) - 1e-12).mean())
    got = flip(ds)
    assert not got.is_exact and got.p_value == pytest.approx(wanted, abs=0.015) and flip(ds).p_value == got.p_value
    assert flip([1.0] * 30).p_value == pytest.approx(1 / 10_001)


def test_holm_by_ranges(spark):
    rng = random.Random(8)
    ps = [(i, round(rng.random() ** 4 / 20, 6)) for i in range(300)]
    ordered, top, wanted = sorted(ps, key=lambda x: (x[1], x[0])), 0.0, {}
    for k, (i, p) in enumerate(ordered):
        top = max(top, min(1.0, (len(ps) - k) * p))
        wanted[i] = top
    got = {r.i: r.adjusted for r in metrics.holm(spark.createDataFrame(ps, "i long, p double"), "i", "p").collect()}
    assert got == pytest.approx(wanted)
    three = metrics.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i long, p double"), "i", "p")
    assert {r.i: round(r.adjusted, 9) for r in three.collect()} == {1: 0.03, 2: 0.06, 3: 0.06}


def test_calibration_curve(spark):
    rows = [(1, k, int(k % 3 == 0), int(k % 3 != 0) + 2) for k in (1, 1, 2, 7)]
    g = spark.createDataFrame(rows, "g int, k long, pos long, neg long").groupBy("g", "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    for strategy in ("uniform", "quantile"):
        p = np.array([k / 10 for _, k, a, b in rows for _ in range(a + b)])
        edges = np.linspace(0, 1, 6) if strategy == "uniform" else np.percentile(p, np.linspace(0, 100, 6))
        for i in range(1, 6):
            if strategy == "quantile" and edges[i] <= edges[i - 1]:
                edges[i] = edges[i - 1] + 1e-6
        at = np.digitize(p, edges[1:-1])
        out = metrics.calibration_curve(g, ["g"], F.col("k") / 10, 5, strategy).orderBy("bin").collect()
        assert [r.n for r in out] == [int((at == b).sum()) for b in range(5)]
        for b, r in enumerate(out):
            assert r.confidence == pytest.approx(p[at == b].mean() if r.n else (edges[b] + edges[b + 1]) / 2)


def test_control_reference(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", math.nan), ("a", None)], "k string, v double")
    assert tuple(fitting.control_reference(df, ["k"], "v").first()) == ("a", 2, 2.0, 1.0)
    with pytest.raises(Exception, match="no scale"):
        fitting.control_reference(df.filter("v = 1"), ["k"], "v").collect()


def test_t_critical_column(spark):
    out = fitting.with_t_critical(spark.createDataFrame([(1,), (4,), (4,), (30,), (0,), (None,)], "df int"), "df", 0.95)
    assert sorted((round(r.critical, 3) for r in out.collect() if r.critical), reverse=True) == [12.706, 2.776, 2.776, 2.042]


def test_leads_by_category(spark):
    events = spark.createDataFrame([(1, 1, "minor"), (1, 2, "major"), (2, 1, "major")], "site long, event_id long, category string")
    found = spark.createDataFrame([(1, 9, 0, 2, 10.0, 14.0), (2, 8, 0, 1, 4.0, 4.0), (2, 7, 0, None, None, None)], "site long, obs_id long, t long, event_id long, lead_lower double, lead_upper double")
    out = {r.category: (r.n_events, r.n_detected, r.recall, r.mean_lead, r.median_lead, r.min_lead, r.max_lead) for r in leadtime.by_category(found, events, ("action", "minor", "major")).collect()}
    assert out == {"action": (0, 0, 0.0, None, None, None, None), "minor": (1, 0, 0.0, None, None, None, None), "major": (2, 2, 1.0, 8.0, 8.0, 4.0, 12.0)}


def test_a_manifest_is_parsed_once(spark):
    out = spark.range(3).select(providers.manifest_problem(F.concat(F.lit('{"pages":["p"],"n":'), F.col("id").cast("string"), F.lit("}"))).alias("problem"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.problem for r in out.collect()} == {"sites_missing"}
