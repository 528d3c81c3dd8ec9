"""Forward passes of sequence models in numpy batches: entity-aware LSTM, causal encoder, reconstruction scores.

A row is a sample with its whole sequence. Weights are a dict of named arrays, broadcast
once after a check of their size. Samples of equal length in an Arrow batch go through
together. What is not finite, in or out, raises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Weights = dict[str, np.ndarray]
#: Bytes of weights that are broadcast.
MOST_BYTES = 256 << 20
#: Numbers of input that layers work on together, about; layers hold some hundred times as much.
BATCH_NUMBERS = 1 << 16


def finite(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("a network's input or output is not finite")
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def normal_share(x: np.ndarray) -> np.ndarray:
    """The normal distribution's cumulated density, by the error function itself."""
    flat = (x / math.sqrt(2.0)).ravel()
    return 0.5 * (1.0 + np.fromiter(map(math.erf, flat.tolist()), dtype=float, count=len(flat)).reshape(x.shape))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * normal_share(x)


def affine(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """x through the named matrix (out, in) and, if there is one, its bias."""
    out = x @ w[f"{name}.weight"].T
    return out + w[f"{name}.bias"] if f"{name}.bias" in w else out


def normalized(w: Weights, name: str, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    gap = x - x.mean(axis=-1, keepdims=True)
    return gap / np.sqrt((gap * gap).mean(axis=-1, keepdims=True) + eps) * w[f"{name}.weight"] + w[f"{name}.bias"]


def causal_convolution(w: Weights, name: str, x: np.ndarray, dilation: int) -> np.ndarray:
    """Each step sees itself and steps `dilation` apart before it; zeros stand before the first. x is (sample, step, channel)."""
    kernel = w[f"{name}.weight"]  # (out, in, taps), the last tap is the step itself
    out = np.broadcast_to(w[f"{name}.bias"], (*x.shape[:2], kernel.shape[0])).copy()
    for back in range(kernel.shape[2]):
        shift = back * dilation
        if shift < x.shape[1]:
            out[:, shift:] += x[:, : x.shape[1] - shift] @ kernel[:, :, kernel.shape[2] - 1 - back].T
    return out


def convolution_block(w: Weights, name: str, x: np.ndarray, dilation: int) -> np.ndarray:
    h = x
    for k in (1, 2):
        h = gelu(normalized(w, f"{name}.norm{k}", causal_convolution(w, f"{name}.conv{k}", h, dilation)))
    return finite(x + h)


def causal_attention(w: Weights, name: str, x: np.ndarray, heads: int) -> np.ndarray:
    n, steps, width = x.shape
    split = lambda y: y.reshape(n, steps, heads, width // heads).transpose(0, 2, 1, 3)
    q, k, v = (split(affine(w, f"{name}.{p}", x)) for p in ("q", "k", "v"))
    score = q @ k.transpose(0, 1, 3, 2) / math.sqrt(width // heads)
    score = np.where(np.tri(steps, dtype=bool), score, -np.inf)
    score = np.exp(score - score.max(axis=-1, keepdims=True))
    mixed = (score / score.sum(axis=-1, keepdims=True)) @ v
    return affine(w, f"{name}.out", mixed.transpose(0, 2, 1, 3).reshape(n, steps, width))


def attention_block(w: Weights, name: str, x: np.ndarray, heads: int) -> np.ndarray:
    x = x + causal_attention(w, f"{name}.attention", normalized(w, f"{name}.norm1", x), heads)
    return finite(x + affine(w, f"{name}.shrink", gelu(affine(w, f"{name}.widen", normalized(w, f"{name}.norm2", x)))))


def encode(w: Weights, x: np.ndarray, heads: int = 4) -> np.ndarray:
    """Projection, convolution blocks whose dilation doubles, attention blocks, norm; as many blocks as the weights have."""
    h = affine(w, "input", finite(x))
    i = 0
    while f"conv.{i}.conv1.weight" in w:
        h, i = convolution_block(w, f"conv.{i}", h, 1 << i), i + 1
    i = 0
    while f"attend.{i}.attention.q.weight" in w:
        h, i = attention_block(w, f"attend.{i}", h, heads), i + 1
    return finite(normalized(w, "final", h))


def head(w: Weights, name: str, z: np.ndarray) -> np.ndarray:
    return finite(affine(w, f"{name}.1", gelu(affine(w, f"{name}.0", z))))


def forecast(w: Weights, x: np.ndarray, heads: int = 4) -> np.ndarray:
    """The forecasting head at the last step."""
    return head(w, "forecast", encode(w, x, heads)[:, -1])


def reconstruct(w: Weights, values: np.ndarray, visible: np.ndarray, heads: int = 4) -> np.ndarray:
    """Values of all channels from the visible ones and which they are."""
    return head(w, "reconstruct", encode(w, np.concatenate((np.where(visible, values, 0.0), visible), axis=-1), heads))


def step_errors(w: Weights, values: np.ndarray, observed: np.ndarray, heads: int = 4) -> np.ndarray:
    """Mean squared error of each step's observed channels, each channel rebuilt while it is withheld whole; 0 for a step without any."""
    errors = np.zeros_like(values)
    for c in range(values.shape[2]):
        visible = observed.copy()
        visible[:, :, c] = False
        errors[:, :, c] = (reconstruct(w, values, visible, heads)[:, :, c] - values[:, :, c]) ** 2
    return finite(np.where(observed, errors, 0.0).sum(axis=-1) / np.maximum(observed.sum(axis=-1), 1))


def reconstruction_score(w: Weights, values: np.ndarray, observed: np.ndarray, how: str = "mean", heads: int = 4) -> np.ndarray:
    """One score a sample: mean or max over steps with an observation, or tail, that of the last step; 0 without any step."""
    return summarized(step_errors(w, values, observed, heads), observed, how)


def summarized(steps: np.ndarray, observed: np.ndarray, how: str) -> np.ndarray:
    """One score a sample from its steps' errors."""
    valid = observed.any(axis=-1)
    if how == "tail":
        return steps[:, -1]
    if how == "max":
        return np.where(valid.any(axis=1), np.where(valid, steps, -np.inf).max(axis=1), 0.0)
    if how == "mean":
        return (steps * valid).sum(axis=1) / np.maximum(valid.sum(axis=1), 1)
    raise ValueError(f"unknown aggregation {how}")


def entity_lstm(w: Weights, x: np.ndarray, static: np.ndarray) -> np.ndarray:
    """Logits of an LSTM whose input gate comes from a sample's static features alone."""
    finite(x), finite(static)
    gate = sigmoid(affine(w, "gate", static))
    hidden = cell = np.zeros((len(x), gate.shape[1]))
    for step in range(x.shape[1]):
        forget, new, out = (affine(w, f"{g}.x", x[:, step]) + affine(w, f"{g}.h", hidden) for g in ("forget", "cell", "output"))
        cell = sigmoid(forget) * cell + gate * np.tanh(new)
        hidden = finite(sigmoid(out) * np.tanh(cell))
    return finite(affine(w, "class.1", np.maximum(affine(w, "class.0", hidden), 0.0)))[:, 0]


def stacked(batch: pa.RecordBatch, first: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows of equal shapes and their nested columns from `first` on as arrays, some BATCH_NUMBERS numbers at a time."""
    # a piece of the batch at a time becomes Python objects, whatever Spark's batch size
    step = max(1, batch.num_rows * 8 * BATCH_NUMBERS // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        piece = batch.slice(start, step)
        parts = [[np.array(v, dtype=bool if isinstance(v[0], list) and isinstance(v[0][0], bool) else float) for v in c.to_pylist()] for c in piece.columns[first:]]
        by_shape: dict[tuple, list[int]] = {}
        for i in range(piece.num_rows):
            by_shape.setdefault(tuple(p[i].shape for p in parts), []).append(i)
        for rows in by_shape.values():
            most = max(1, BATCH_NUMBERS // max(1, sum(p[rows[0]].size for p in parts)))
            for k in range(0, len(rows), most):
                some = rows[k : k + most]
                yield [start + i for i in some], [np.stack([p[i] for i in some]) for p in parts]


def applied(samples: DataFrame, weights: Weights, run: Callable[..., np.ndarray], columns: tuple[str, ...], key: str = "sample", names: tuple[str, ...] = ("score",)) -> DataFrame:
    """(sample, score) of run(weights, arrays...) over the named nested array columns; a null in one of them raises.

    With several names, run gives a column of each.
    Sequences may differ in length between samples; those of equal length go together.
    """
    size = sum(a.nbytes for a in weights.values())
    if size > MOST_BYTES:
        raise ValueError(f"weights of {size} bytes are not broadcast")
    held = samples.sparkSession.sparkContext.broadcast(weights)
    kind = samples.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)))
            for rows, arrays in stacked(batch, 1):
                out[rows] = run(held.value, *arrays).reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.T)], [key, *names])

    return samples.select(key, *columns).mapInArrow(scored, ", ".join([f"{key} {kind}", *(f"{n} double" for n in names)]))
