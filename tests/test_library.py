"""Window forms against plain folds, hand cases, fits, streams; order of rows must not matter."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import audits, daily, fitting, graph, leadtime, metrics, series
from tidemark.streaming import charts

DAY0 = dt.date(2024, 1, 1)
HOUR = series.HOUR


def fold_trace(classes: str) -> list[tuple[str, str, int]]:
    """(state before, state after, low run) of each day, as a plain recurrence."""
    state, low, out = "unarmed_initial", 0, []
    for c in classes:
        before = state
        if c == "U":
            state, low = "unresolved", 0
        elif c == "H":
            state = "active" if state in ("armed", "active", "recovering") else "unresolved"
            low = 0
        else:
            low = min(low + 1, 3)
            if state in ("active", "recovering"):
                state = "armed" if low == 3 else "recovering"
            elif low == 3:
                state = "armed"
        out.append((before, state, low))
    return out


def test_trace_is_the_fold(spark):
    rng = random.Random(1)
    many = ["".join(rng.choice("LLLHU") for _ in range(25)) for _ in range(150)] + ["LLLH", "HLLH", "LLLHHLLLH", "LLLHLUULLHLLLH"]
    rows = [(s, DAY0 + dt.timedelta(i), c) for s, classes in enumerate(many) for i, c in enumerate(classes)]
    rng.shuffle(rows)
    out = daily.state_trace(spark.createDataFrame(rows, "site int, local_date date, class string"), ("site",)).collect()
    got = {(r.site, r.local_date): (r.state_before, r.state_after, r.below_run) for r in out}
    for s, classes in enumerate(many):
        assert [got[s, DAY0 + dt.timedelta(i)] for i in range(len(classes))] == fold_trace(classes)


def test_future_rows_do_not_change_the_past(spark):
    rows = [(1, DAY0 + dt.timedelta(i), c) for i, c in enumerate("LLLHLLULLLHH")]
    trace = lambda x: {r.local_date: r.state_after for r in daily.state_trace(spark.createDataFrame(x, "site int, local_date date, class string"), ("site",)).collect()}
    whole, part = trace(rows), trace(rows[:7])
    assert all(whole[d] == s for d, s in part.items())


def exact_type8(values: list[Decimal], p: Fraction) -> Fraction:
    v, n = sorted(values), len(values)
    h = min(max((n + Fraction(1, 3)) * p + Fraction(1, 3), Fraction(1)), Fraction(n))
    j = int(h)
    return Fraction(v[j - 1]) + (h - j) * (Fraction(v[min(j, n - 1)]) - Fraction(v[j - 1]))


def test_type8(spark):
    rng = random.Random(2)
    groups = {g: [Decimal(rng.randint(0, 999)) / 100 for _ in range(rng.randint(2, 12))] for g in range(20)} | {99: [Decimal(1), Decimal(2), Decimal(3)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v decimal(18,2)")
    for a, b in ((1, 2), (1, 4), (3, 4), (99, 100)):
        for r in daily.type8(df, ("g",), "v", a, b).collect():
            assert Fraction(r.lo) + (Fraction(r.hi) - Fraction(r.lo)) * Fraction(int(r.g_num), int(r.g_den)) == exact_type8(groups[r.g], Fraction(a, b))
    assert exact_type8(groups[99], Fraction(1, 4)) == Fraction(7, 6)


def test_labels_stay_three_valued(spark):
    rows = [(1, DAY0 + dt.timedelta(i), c) for i, c in enumerate("LLLLHLLLLU")]
    out = {(r.issue_date.day, r.horizon): r.status for r in daily.issue_labels(daily.state_trace(spark.createDataFrame(rows, "site int, local_date date, class string"), ("site",)), ("site",)).collect()}
    assert out[4, 24] == "negative" and out[5, 24] == "positive" and out[4, 48] == "positive"
    assert out[1, 24] == "unknown" and out[9, 48] == "unknown" and out[10, 24] == "unknown"


def test_episodes(spark):
    cases = {
        1: [(0, 2), (0.25, 2.8), (0.5, 3.2), (0.75, 2.5), (30, 2)], 2: [(0, 2), (1, 3.2), (2, 3.5), (4, 2.8), (8, 2.7), (12, 4.2), (16, 2.9), (45, 2)],
        3: [(0, 2), (1, 3.2), (2, 3.5), (4, 2.5), (32, 2.5), (35, 3.4), (38, 3.8), (40, 2.5), (70, 2)], 4: [(0, 3.5), (2, 4), (5, 2.5), (35, 2)], 5: [(0, 2), (1, 3.2), (3, 4.5)],
    }
    rows = [(s, i, int(h * HOUR), float(v)) for s, obs in cases.items() for i, (h, v) in enumerate(obs)]
    out = sorted(series.episodes(spark.createDataFrame(rows, "site int, obs_id int, t long, value double"), 3.0).collect(), key=lambda r: (r.site, r.episode))
    brief = [(r.site, None if r.onset_lower is None else r.onset_lower / HOUR, r.onset_upper / HOUR, r.peak_value, None if r.end_t is None else r.end_t / HOUR, r.left_censored, r.right_censored) for r in out]
    assert brief == [
        (1, 0.25, 0.5, 3.2, 0.5, False, False), (2, 0, 1, 4.2, 12, False, False), (3, 0, 1, 3.5, 2, False, False), (3, 32, 35, 3.8, 38, False, False),
        (4, None, 0, 4.0, 2, True, False), (5, 0, 1, 4.5, None, False, True),
    ]


def test_onsets_are_the_fold(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for s in range(80):
        active, low_start, last_low, previous = False, None, None, None
        day = 0
        for _ in range(25):
            day += rng.choice([1, 1, 1, 1, 2])
            c = rng.choice("LLLHU")
            rows.append((s, DAY0 + dt.timedelta(day), {"L": 1.0, "H": 3.0, "U": None}[c], c != "U"))
            if previous is not None and day - previous != 1:
                low_start = None
            previous, onset, lower = day, False, None
            if c == "U":
                low_start, risk = None, None
            elif c == "L":
                low_start = day if low_start is None else low_start
                active = active and day - low_start < 3
                last_low, risk = day, not active
            else:
                onset, lower = not active, None if active else last_low
                active, low_start, risk = True, None, False
            expected[s, day] = (onset, None if lower is None else DAY0 + dt.timedelta(lower), risk)
    rng.shuffle(rows)
    out = series.onsets(spark.createDataFrame(rows, "site int, day date, value double, usable boolean"), 2.0)
    assert {(r.site, (r.day - DAY0).days): (r.is_onset, r.onset_lower, r.at_risk) for r in out.collect()} == expected


def test_ranking_hand_cases(spark):
    pred = spark.createDataFrame([("a", 1, 25), ("a", 0, 25), ("a", 0, 25), ("a", 0, 25), ("b", 1, 9), ("b", 0, 8), ("b", 1, 7), ("b", 0, 1), ("c", 0, 1), ("c", 0, 2)], "g string, y int, k int")
    out = {r.g: r for r in metrics.ranking(metrics.grouped(pred, ("g",)), ("g",)).collect()}
    assert (out["a"].ap, out["a"].auroc, out["a"].pr_auc) == (0.25, 0.5, 0.625)
    assert out["b"].ap == pytest.approx(5 / 6) and out["b"].pr_auc == pytest.approx(19 / 24)
    assert (out["c"].ap, out["c"].auroc, out["c"].pr_auc) == (None, None, None)


def test_murphy_identity(spark):
    rng = random.Random(5)
    g = metrics.grouped(spark.createDataFrame([(1, rng.randint(0, 1), rng.randint(0, 10)) for _ in range(300)], "g int, y int, k int"), ("g",))
    m, p = metrics.murphy(g, ("g",), F.col("k") / 10).first(), metrics.probability(g, ("g",), F.col("k") / 10).first()
    assert m.reliability - m.resolution + m.uncertainty == pytest.approx(p.brier, abs=1e-12)


def test_holm_and_sign_flip(spark):
    out = metrics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "k", "p")
    assert {r.k: round(r.adjusted, 9) for r in out.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert metrics.sign_flip(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "d double")).first().p_value == 0.0625


def test_charts(spark):
    out = series.ewma_cusum(spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 1, 4.0)], "site long, t long, obs_id long, value double"), 0.0, 2.0, 0.5, 0.25)
    assert [r.cusum for r in out.orderBy("t").collect()] == [0.25, 1.25]


def test_cooldown_and_match(spark):
    rng = random.Random(7)
    alerts = sorted({(rng.randint(0, 3), rng.randint(0, 400) * HOUR) for _ in range(150)})
    alerts = [(s, t, i) for i, (s, t) in enumerate(alerts)]
    kept, last = [], {}
    for s, t, i in alerts:
        if s not in last or t - last[s] >= 12 * HOUR:
            last[s] = t
            kept.append((s, t, i))
    df = spark.createDataFrame(alerts, "site long, t long, obs_id long")
    assert sorted((r.site, r.t, r.obs_id) for r in series.cooldown(df, 12).collect()) == kept
    events = []
    for e in range(60):
        lower = rng.randint(0, 450) * HOUR
        events.append((rng.randint(0, 3), e, None if e % 9 == 0 else lower, lower + rng.randint(0, 30) * HOUR))
    used, expected = set(), {}
    for s, t, i in kept:
        fit = [(lo, e, up) for es, e, lo, up in events if es == s and lo is not None and e not in used and (0 <= up - t <= 72 * HOUR or 0 <= lo - t <= 72 * HOUR)]
        expected[i] = min(fit)[1] if fit else None
        used.add(expected[i])
    out = leadtime.match(series.cooldown(df, 12), spark.createDataFrame(events, "site long, event_id long, onset_lower long, onset_upper long"), 72)
    assert {r.obs_id: r.event_id for r in out.collect()} == expected


def test_visible(spark):
    obs = spark.createDataFrame([(1, 24, 38, 5.0), (1, 48, 50, 6.0)], "site long, t_end long, t_available long, value double")
    issues = spark.createDataFrame([(1, 24), (1, 38), (1, 49), (1, 50)], "site long, t_issue long")
    assert [(r.n_visible, r.latest_value) for r in series.visible(obs, issues).orderBy("t_issue").collect()] == [(0, None), (1, 5.0), (1, 5.0), (2, 6.0)]


def test_civil_days(spark):
    cases = [("America/New_York", "2024-03-10", 23.0), ("America/New_York", "2024-11-03", 25.0), ("America/New_York", "2024-06-01", 24.0), ("America/Sao_Paulo", "2017-10-15", None), ("America/Havana", "2024-11-03", None), ("Asia/Kolkata", "2024-05-05", 24.0)]
    for zone, day, hours in cases:
        r = spark.range(1).select(scalars.civil_day(F.lit(day).cast("date"), zone).alias("d")).select("d.status", ((F.unix_seconds("d.end") - F.unix_seconds("d.start")) / 3600).alias("h")).first()
        assert (r.status, r.h) == (("unresolved", None) if hours is None else ("mapped", hours)), (zone, day)


def test_units_fail_closed(spark):
    one = lambda v, u: spark.range(1).select(scalars.to_si(F.lit(v), F.lit(u)).alias("x")).first().x
    assert one(1.0, "ft").value == 0.3048 and one(1.0, "bushel").value is None
    with pytest.raises(Exception, match="absolute zero"):
        one(-300.0, "degC")


def test_isotonic_and_steps(spark):
    rng = random.Random(9)
    rows = [(g, k, rng.randint(0, 5), rng.randint(1, 5)) for g in range(4) for k in range(9)]
    out = {(r.g, r.k): r.fitted for r in fitting.isotonic(spark.createDataFrame(rows, "g int, k int, pos int, neg int"), "g").collect()}
    for g in range(4):
        p = {k: (a, a + b) for x, k, a, b in rows if x == g}
        for k in p:
            best = max(min(sum(p[i][0] for i in range(lo, hi + 1)) / sum(p[i][1] for i in range(lo, hi + 1)) for hi in range(k, 9)) for lo in range(k + 1))
            assert out[g, k] == pytest.approx(best)


def test_linear_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = x @ [0.5, -0.25] + 0.1
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    assert fitting.ridge(rows, ("a", "b"), "y", l2=0.0) == pytest.approx([0.5, -0.25, 0.1], abs=1e-6)
    v = rng.normal(size=(50, 3))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, e array<double>")
    mean, factor = fitting.covariance_reference(vectors, "e", 0.2)
    cov = np.cov(v.T)
    target = 0.8 * cov + 0.2 * np.trace(cov) / 3 * np.eye(3)
    assert factor @ factor.T == pytest.approx(target)
    got = {r.id: r.distance for r in fitting.mahalanobis(vectors, "id", "e", mean, factor).collect()}
    assert [got[i] for i in range(50)] == pytest.approx([d @ np.linalg.solve(target, d) for d in v - v.mean(0)])
    assert fitting.t_critical(0.95, 4) == pytest.approx(2.7764, abs=1e-3)


def test_embargo_sweep(spark):
    rng = random.Random(4)
    parts = []
    for i in range(60):
        start = rng.randint(0, 2000) * HOUR
        parts.append((i % 3, i, rng.choice(["train", "test", "validation"]), start, start + rng.randint(1, 60) * HOUR))
    out = audits.embargo(spark.createDataFrame(parts, "cluster int, part int, split string, t_start long, t_end long"), ("train", "validation", "test"), 24)
    bad = {p[1] for p in parts for q in parts if p[0] == q[0] and p[2] != q[2] and (q[3], q[1]) < (p[3], p[1]) and p[3] - q[4] < 24 * HOUR}
    assert {r.part for r in out.collect()} == bad


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(20, 25), (25, 22)], "a long, b long")
    out = {r.node: r.root for r in graph.components(nodes, edges).collect()}
    assert all(out[i] == 0 for i in range(15)) and out[22] == out[25] == out[20] == 20 and out[29] == 29


def test_violations(spark):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    assert sorted((r.id, r.rule) for r in audits.violations(rows, "id", {"positive": F.col("v") > 0, "small": F.col("v") < 4}).collect()) == [(1, "small"), (2, "positive"), (3, "positive"), (3, "small")]


def test_stream_equals_batch(spark, tmp_path):
    """Days shuffled over three waves, a start from the checkpoint for each: the chart of the ordered days."""
    rng = random.Random(6)
    schema = "site long, day date, value double"
    rows = [(s, DAY0 + dt.timedelta(d), None if rng.random() < 0.2 else rng.uniform(0, 10)) for s in range(5) for d in range(30)]
    waves: list[list] = [[], [], [(None, DAY0 + dt.timedelta(90), None)]]
    for r in rows:
        waves[int((r[1] - DAY0).days + rng.randint(0, 9) > 16)].append(r)
    seen = []
    for wave in waves:
        rng.shuffle(wave)
        spark.createDataFrame(wave, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        charts.run_available(spark, charts.stream_control_chart(stream, 5.0, 2.0), f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append(spark.read.schema(charts.OUTPUT).parquet(f"{tmp_path}/out").count())
    assert 0 < seen[1] < seen[2] == len(rows)
    got = {(r.site, r.day): (r.ewma, r.cusum, r.score) for r in spark.read.schema(charts.OUTPUT).parquet(f"{tmp_path}/out").collect()}
    batch = series.control_chart(spark.createDataFrame(rows, schema), 5.0, 2.0)
    assert got == {(r.site, r.day): (r.ewma, r.cusum, r.score) for r in batch.collect()}


@pytest.mark.parametrize(("days", "message"), [([0, 1, 3], "does not follow"), ([0, 1, 1], "comes again")])
def test_stream_refuses_holes_and_repeats(spark, tmp_path, days, message):
    schema = "site long, day date, value double"
    rows = [(1, DAY0 + dt.timedelta(d), 1.0) for d in days] + [(None, DAY0 + dt.timedelta(90), None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match=message):
        charts.run_available(spark, charts.stream_control_chart(stream, 5.0, 2.0), f"{tmp_path}/out", f"{tmp_path}/state")


def test_steps_over_slices(spark):
    """Thresholds and scores cut into slices of a few rows, null keys and scores included; no frame looks ahead through a whole key."""
    rng = random.Random(4)
    marks = [(k, x, rng.random()) for k in ("a", "b", None) for x in rng.sample(range(100), 30)]
    asked = [(k, rng.choice([None, *range(-5, 110)]), f"{i}") for i, k in enumerate(rng.choices(["a", "b", "c", None], k=400))]
    fitted = spark.createDataFrame(marks, "key string, k long, fitted double")
    out = fitting.step_predict(spark.createDataFrame(asked, "key string, k long, id string"), fitted, slice_rows=7)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()

    def expected(key, s):
        mine = sorted((x, v) for k, x, v in marks if k == key)
        below = [v for x, v in mine if s is not None and x <= s]
        return below[-1] if below else mine[0][1] if mine else None

    assert {(r.key, r.id, r.k, r.p) for r in out.collect()} == {(k, i, s, expected(k, s)) for k, s, i in asked}
