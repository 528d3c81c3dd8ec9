"""Gradients against differences, distributed training against one process, checkpoints."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gradients, networks, training
from tidemark.plans import networks as plan

SETTINGS = training.Settings(epochs=3, patience=3, rate=0.02, decay=0.01, blocks=2)


def differences(loss, w, names_of_each=4, step=1e-6):
    """(found, expected) derivatives at a few places of every array."""
    _, _, g = loss(w)
    rng = np.random.default_rng(0)
    assert g.keys() == w.keys()
    for name in w:
        for place in rng.choice(w[name].size, min(names_of_each, w[name].size), replace=False):
            ends = []
            for sign in (1, -1):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name].flat[place] += sign * step
                ends.append(loss(moved)[0])
            yield name, g[name].flat[place], (ends[0] - ends[1]) / (2 * step)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(2)
    x, static, label = rng.standard_normal((5, 7, 3)), rng.standard_normal((5, 2)), np.array([[0.0], [1], [1], [0], [1]])
    lstm = plan.drawn(plan.lstm_shapes(3, 2, 4))
    for name, found, expected in differences(lambda w: gradients.entity_lstm_loss(w, x, static, label), lstm):
        assert found == pytest.approx(expected, abs=1e-6), name
    seen = rng.random(x.shape) < 0.7
    hidden = seen & (rng.random(x.shape) < 0.4)
    masked = plan.drawn(plan.encoder_shapes(6, 8, 2, 2) | plan.head_shapes("reconstruct", 8, 3))
    for name, found, expected in differences(lambda w: gradients.masked_loss(w, x, seen, hidden, 2), masked):
        assert found == pytest.approx(expected, abs=1e-5), name
    with pytest.raises(ValueError, match="no target"):
        gradients.masked_loss(masked, x, seen, np.ones_like(seen), 2)


def test_losses_are_those_of_the_forward_passes():
    rng = np.random.default_rng(3)
    x, static, label = rng.standard_normal((6, 5, 3)), rng.standard_normal((6, 2)), (rng.random((6, 1)) < 0.5).astype(float)
    lstm = plan.drawn(plan.lstm_shapes(3, 2, 4))
    p = networks.sigmoid(networks.entity_lstm(lstm, x, static))
    assert gradients.entity_lstm_loss(lstm, x, static, label)[0] == pytest.approx(-(label[:, 0] * np.log(p) + (1 - label[:, 0]) * np.log(1 - p)).sum())
    seen = rng.random(x.shape) < 0.7
    hidden = seen & (rng.random(x.shape) < 0.4)
    w = plan.drawn(plan.encoder_shapes(6, 8) | plan.head_shapes("reconstruct", 8, 3))
    total, count, _ = gradients.masked_loss(w, x, seen, hidden, 2)
    assert count == hidden.sum() and total == pytest.approx(((networks.reconstruct(w, x, seen & ~hidden, 2) - x)[hidden] ** 2).sum())


def planted(spark, n=120):
    """Windows of 5 or 8 steps whose label is the sign of the last step's first channel."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = rng.standard_normal((5 if i % 3 else 8, 2))
        rows.append((i, x.tolist(), rng.standard_normal(2).tolist(), [float(x[-1, 0] > 0)], i % 4 == 0))
    return spark.createDataFrame(rows, "sample long, x array<array<double>>, static array<double>, label array<double>, validation boolean")


def lstm_loss(epoch):
    return gradients.entity_lstm_loss


COLUMNS = ("x", "static", "label")


def test_training_is_that_of_one_process(spark):
    samples = planted(spark).repartition(5)
    w = plan.drawn(plan.lstm_shapes(2, 2, 4))
    found = training.train(samples, w, lstm_loss, COLUMNS, SETTINGS)

    rows = samples.withColumn("block", F.when(F.col("validation"), -1).otherwise(F.pmod(F.xxhash64(F.col("sample").cast("string")), F.lit(2)))).collect()
    at, mean, square, steps = {k: v.copy() for k, v in w.items()}, {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0

    def over(block):
        total, grads, some = 0.0, {k: np.zeros_like(v) for k, v in w.items()}, [r for r in rows if r.block == block]
        for r in some:
            one, _, g = gradients.entity_lstm_loss(at, np.array([r.x]), np.array([r.static]), np.array([r.label]))
            total += one
            grads = {k: grads[k] + g[k] for k in grads}
        return total / len(some), {k: v / len(some) for k, v in grads.items()}

    for e in found.trace:
        losses = []
        for block in (0, 1):
            value, g = over(block)
            losses.append(value)
            steps += 1
            for k in at:
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g[k], 0.999 * square[k] + 0.001 * g[k] ** 2
                at[k] = at[k] * (1 - 0.02 * 0.01) - 0.02 * (mean[k] / (1 - 0.9**steps)) / (np.sqrt(square[k] / (1 - 0.999**steps)) + 1e-8)
        assert e.train_loss == pytest.approx(np.mean(losses), abs=1e-9) and e.validation_loss == pytest.approx(over(-1)[0], abs=1e-9)
    assert len(found.trace) == 3
    if found.best_epoch == 3:
        assert all(np.allclose(found.weights[k], at[k], atol=1e-9) for k in at)


def test_training_learns_and_stops(spark):
    w = plan.drawn(plan.lstm_shapes(2, 2, 4))
    found = training.train(planted(spark), w, lstm_loss, COLUMNS, training.Settings(epochs=12, rate=0.1, decay=0.0, blocks=2))
    assert found.trace[found.best_epoch - 1].validation_loss < 0.35 < found.trace[0].train_loss
    stopped = training.train(planted(spark), w, lstm_loss, COLUMNS, training.Settings(epochs=9, patience=2, least_gain=10.0, blocks=1))
    assert len(stopped.trace) == 3 and stopped.best_epoch == 1  # the first epoch always gains; then two that do not
    with pytest.raises(ValueError, match="target"):
        training.train(planted(spark).filter("validation"), w, lstm_loss, COLUMNS, SETTINGS)
    with pytest.raises(ValueError, match="rate"):
        training.Settings(rate=0.0)


def test_checkpoints(spark, tmp_path):
    w = plan.drawn(plan.lstm_shapes(2, 2, 4))
    shapes, path = {k: v.shape for k, v in w.items()}, f"{tmp_path}/model"
    training.save(spark, w, path)
    again = training.load(spark, path, shapes)
    assert again.keys() == w.keys() and all((again[k] == w[k]).all() for k in w)
    with pytest.raises(ValueError, match="gate.bias"):
        training.load(spark, path, shapes | {"gate.bias": (9,)})
    spark.read.parquet(path).withColumn("sha256", F.when(F.col("name") == "forget.x.bias", "0").otherwise(F.col("sha256"))).write.parquet(f"{tmp_path}/changed")
    with pytest.raises(ValueError, match="forget.x.bias was changed"):
        training.load(spark, f"{tmp_path}/changed", shapes)


def test_drawn_masks():
    rng = np.random.default_rng(1)
    observed = rng.random((400, 9, 3)) < 0.5
    observed[0] = False
    observed[1] = False
    observed[1, 4, 2] = True
    ids = np.arange(400.0)
    mask = training.drawn_mask(7, ids, observed, 0.25)
    assert not (mask & ~observed).any() and not mask[0].any() and mask[1, 4, 2] and mask[1:].reshape(399, -1).any(axis=1).all()
    assert 0.22 < mask.sum() / observed.sum() < 0.28
    assert (training.drawn_mask(7, ids[::-1], observed[::-1], 0.25)[::-1] == mask).all() and (training.drawn_mask(8, ids, observed, 0.25) != mask).any()
