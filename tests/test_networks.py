"""Corruption masks by their rules, forward passes against loops over single numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import corruption, networks
from tidemark.plans import networks as plan


def grid(spark, samples=40, steps=20, channels=3, share=0.6):
    rows = spark.range(samples).withColumnRenamed("id", "sample").select("sample", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t")).select("sample", "t", F.explode(F.array(*[F.lit(f"c{i}") for i in range(channels)])).alias("channel"))
    return rows.withColumn("observed", corruption.uniform(5, F.col("sample"), F.col("t"), F.col("channel")) < share)


@pytest.mark.parametrize("share", [0.6, 0.01])
@pytest.mark.parametrize("mode", ["random", "channel", "span", "mixed"])
def test_masks(spark, mode, share):
    rows = corruption.corruption(grid(spark, share=share), mode, rate=0.2, span=6, seed=3).collect()
    by_sample: dict = {}
    for r in rows:
        by_sample.setdefault(r.sample, []).append(r)
    seen_modes = set()
    for some in by_sample.values():
        observed, hidden = [r for r in some if r.observed], [r for r in some if r.hidden]
        assert all(r.observed for r in hidden) and bool(hidden) == bool(observed)
        told = some[0].mode
        seen_modes.add(told)
        if told == "channel" and observed:
            assert len({r.channel for r in hidden}) == 1 and len(hidden) == sum(r.channel == hidden[0].channel for r in observed)
        if told == "span" and observed:
            assert max(r.t for r in hidden) - min(r.t for r in hidden) < 6
            if len(hidden) > 1:  # some six days of all channels, whole
                low, high = min(r.t for r in hidden), max(r.t for r in hidden)
                assert {(r.t, r.channel) for r in hidden} == {(r.t, r.channel) for r in observed if low <= r.t <= high}
    assert seen_modes == ({"random", "channel", "span"} if mode == "mixed" else {mode})
    if mode == "random" and share == 0.6:
        assert 0.15 < sum(r.hidden for r in rows) / sum(r.observed for r in rows) < 0.25
    again = corruption.corruption(grid(spark, share=share).repartition(7), mode, rate=0.2, span=6, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_masks_refuse(spark):
    with pytest.raises(ValueError, match="rate"):
        corruption.corruption(grid(spark), "random", rate=1.0)
    with pytest.raises(Exception, match="unknown corruption mode"):
        corruption.corruption(grid(spark), "other").collect()
    nothing = corruption.corruption(grid(spark).withColumn("observed", F.lit(False)), "span")
    assert nothing.filter("hidden").count() == 0


# plain loops


def dot(w, name, x):
    out = [sum(float(a) * b for a, b in zip(row, x, strict=True)) for row in w[f"{name}.weight"]]
    return [a + float(b) for a, b in zip(out, w.get(f"{name}.bias", [0.0] * len(out)), strict=True)]


def plain_norm(w, name, x):
    mean = sum(x) / len(x)
    spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-5)
    return [(v - mean) / spread * float(a) + float(b) for v, a, b in zip(x, w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]


def plain_gelu(x):
    return [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]


def plain_conv(w, name, x, dilation):
    kernel, out = w[f"{name}.weight"], []
    for t in range(len(x)):
        row = []
        for o in range(kernel.shape[0]):
            total = float(w[f"{name}.bias"][o])
            for tap in range(kernel.shape[2]):
                at = t - (kernel.shape[2] - 1 - tap) * dilation
                if at >= 0:
                    total += sum(float(kernel[o, i, tap]) * x[at][i] for i in range(kernel.shape[1]))
            row.append(total)
        out.append(row)
    return out


def plain_encode(w, x, heads):
    h = [dot(w, "input", v) for v in x]
    for i in range(2):
        g = h
        for k in (1, 2):
            g = [plain_gelu(plain_norm(w, f"conv.{i}.norm{k}", v)) for v in plain_conv(w, f"conv.{i}.conv{k}", g, 2**i)]
        h = [[a + b for a, b in zip(u, v, strict=True)] for u, v in zip(h, g, strict=True)]
    normed = [plain_norm(w, "attend.0.norm1", v) for v in h]
    q, k, v = ([dot(w, f"attend.0.attention.{p}", y) for y in normed] for p in "qkv")
    width = len(q[0]) // heads
    mixed = []
    for t in range(len(h)):
        row = []
        for a in range(heads):
            part = slice(a * width, (a + 1) * width)
            scores = [sum(x1 * x2 for x1, x2 in zip(q[t][part], k[s][part], strict=True)) / math.sqrt(width) for s in range(t + 1)]
            weights = [math.exp(s - max(scores)) for s in scores]
            row += [sum(wt * v[s][part][j] for s, wt in enumerate(weights)) / sum(weights) for j in range(width)]
        mixed.append(dot(w, "attend.0.attention.out", row))
    h = [[a + b for a, b in zip(u, m, strict=True)] for u, m in zip(h, mixed, strict=True)]
    h = [[a + b for a, b in zip(u, dot(w, "attend.0.shrink", plain_gelu(dot(w, "attend.0.widen", plain_norm(w, "attend.0.norm2", u)))), strict=True)] for u in h]
    return [plain_norm(w, "final", u) for u in h]


def plain_head(w, name, z):
    return dot(w, f"{name}.1", plain_gelu(dot(w, f"{name}.0", z)))


def test_forward_passes_are_those_of_loops(spark):
    rng = np.random.default_rng(4)
    x = [rng.standard_normal((n, 3)).tolist() for n in (6, 9, 6, 1, 9)]
    seen = [(rng.random((len(v), 3)) < 0.7).tolist() for v in x]
    static = rng.standard_normal((5, 2)).tolist()
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(x, seen, static, strict=True))], "sample long, x array<array<double>>, seen array<array<boolean>>, static array<double>").repartition(2)

    lstm = plan.drawn(plan.lstm_shapes(3, 2, 4))
    found = {r.sample: r.score for r in networks.applied(df, lstm, networks.entity_lstm, ("x", "static")).collect()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for i in range(5):
        gate, h, c = [sig(v) for v in dot(lstm, "gate", static[i])], [0.0] * 4, [0.0] * 4
        for step in x[i]:
            f, g, o = ([a + b for a, b in zip(dot(lstm, f"{n}.x", step), dot(lstm, f"{n}.h", h), strict=True)] for n in ("forget", "cell", "output"))
            c = [sig(a) * b + d * math.tanh(e) for a, b, d, e in zip(f, c, gate, g, strict=True)]
            h = [sig(a) * math.tanh(b) for a, b in zip(o, c, strict=True)]
        assert found[i] == pytest.approx(dot(lstm, "class.1", [max(0.0, v) for v in dot(lstm, "class.0", h)])[0], abs=1e-9)

    w = plan.drawn(plan.encoder_shapes(3, 8) | plan.head_shapes("forecast", 8, 1))
    found = {r.sample: r.score for r in networks.applied(df, w, plan._forecast, ("x",)).collect()}
    for i in range(5):
        assert found[i] == pytest.approx(plain_head(w, "forecast", plain_encode(w, x[i], plan.HEADS)[-1])[0], abs=1e-9)

    w = plan.drawn(plan.encoder_shapes(6, 8) | plan.head_shapes("reconstruct", 8, 3))
    for how in ("mean", "max", "tail"):
        found = {r.sample: r.score for r in networks.applied(df, w, plan._Score(how), ("x", "seen")).collect()}
        for i in range(5):
            per_step = [[] for _ in x[i]]
            for c in range(3):
                visible = [[o and k != c for k, o in enumerate(row)] for row in seen[i]]
                z = plain_encode(w, [[v if o else 0.0 for v, o in zip(a, b, strict=True)] + [float(o) for o in b] for a, b in zip(x[i], visible, strict=True)], plan.HEADS)
                for t, u in enumerate(z):
                    if seen[i][t][c]:
                        per_step[t].append((plain_head(w, "reconstruct", u)[c] - x[i][t][c]) ** 2)
            means = [sum(p) / len(p) if p else None for p in per_step]
            known = [m for m in means if m is not None]
            expected = {"mean": sum(known) / len(known) if known else 0.0, "max": max(known, default=0.0), "tail": means[-1] or 0.0}[how]
            assert found[i] == pytest.approx(expected, abs=1e-9)


def test_the_encoder_sees_no_future_and_refuses_what_is_not_finite():
    rng = np.random.default_rng(1)
    w = plan.drawn(plan.encoder_shapes(3, 8))
    x = rng.standard_normal((2, 12, 3))
    later = x.copy()
    later[:, 7:] += 5
    assert np.allclose(networks.encode(w, x, 2)[:, :7], networks.encode(w, later, 2)[:, :7]) and not np.allclose(networks.encode(w, x, 2), networks.encode(w, later, 2))
    x[0, 0, 0] = np.nan
    with pytest.raises(ValueError, match="finite"):
        networks.encode(w, x, 2)


def test_batches_become_arrays_piece_by_piece(monkeypatch):
    """Rows keep their places, and no piece has more numbers than a layer works on together."""
    rng = np.random.default_rng(3)
    rows = [rng.random((int(n), 2)).tolist() for n in rng.integers(1, 4, 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(rows)], ["sample", "x"])
    monkeypatch.setattr(networks, "BATCH_NUMBERS", 64)
    seen, pieces = {}, 0
    for places, (x,) in networks.stacked(batch, 1):
        assert x.size <= 64
        pieces += 1
        seen |= dict(zip(places, x.tolist(), strict=True))
    assert [seen[i] for i in range(500)] == rows
    assert pieces >= sum(len(r) * 2 for r in rows) // 64


def test_a_score_of_each_kind_by_one_rebuilding(spark, monkeypatch):
    rng = np.random.default_rng(5)
    w = plan.drawn(plan.encoder_shapes(4, plan.WIDTH) | plan.head_shapes("reconstruct", plan.WIDTH, 2))
    x, seen = rng.standard_normal((3, 6, 2)), rng.random((3, 6, 2)) < 0.7
    calls = []
    whole = networks.step_errors
    monkeypatch.setattr(networks, "step_errors", lambda *a: calls.append(1) or whole(*a))
    found = plan._scores(w, x, seen)
    assert len(calls) == 1
    for i, how in enumerate(plan.HOW):
        assert np.allclose(found[:, i], networks.reconstruction_score(w, x, seen, how, plan.HEADS), rtol=1e-12)
