"""Losses of the sequence models with their gradients, in numpy batches.

A layer gives its output and a function that takes the output's gradient, adds the
gradients of the layer's weights to a dict and returns the gradient of its input. A loss
gives (sum, count, gradients of the sum), so that tasks' results add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tidemark.operators import networks
from tidemark.operators.networks import Weights, finite, sigmoid

Back = Callable[[np.ndarray, Weights], np.ndarray]
Loss = tuple[float, float, Weights]


def _add(g: Weights, name: str, value: np.ndarray) -> None:
    g[name] = g[name] + value if name in g else value


def _rows(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def affine(w: Weights, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
    def back(d: np.ndarray, g: Weights) -> np.ndarray:
        _add(g, f"{name}.weight", _rows(d).T @ _rows(x))
        if f"{name}.bias" in w:
            _add(g, f"{name}.bias", _rows(d).sum(axis=0))
        return d @ w[f"{name}.weight"]

    return networks.affine(w, name, x), back


def gelu(x: np.ndarray) -> tuple[np.ndarray, Back]:
    share = networks.normal_share(x)
    return x * share, lambda d, g: d * (share + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi))


def normalized(w: Weights, name: str, x: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, Back]:
    gap = x - x.mean(axis=-1, keepdims=True)
    spread = np.sqrt((gap * gap).mean(axis=-1, keepdims=True) + eps)
    unit = gap / spread

    def back(d: np.ndarray, g: Weights) -> np.ndarray:
        _add(g, f"{name}.weight", _rows(d * unit).sum(axis=0))
        _add(g, f"{name}.bias", _rows(d).sum(axis=0))
        d = d * w[f"{name}.weight"]
        return (d - d.mean(axis=-1, keepdims=True) - unit * (d * unit).mean(axis=-1, keepdims=True)) / spread

    return unit * w[f"{name}.weight"] + w[f"{name}.bias"], back


def causal_convolution(w: Weights, name: str, x: np.ndarray, dilation: int) -> tuple[np.ndarray, Back]:
    kernel = w[f"{name}.weight"]

    def back(d: np.ndarray, g: Weights) -> np.ndarray:
        inner, taps = np.zeros_like(x), np.zeros_like(kernel)
        for tap in range(kernel.shape[2]):
            shift = (kernel.shape[2] - 1 - tap) * dilation
            if shift < x.shape[1]:
                late, early = d[:, shift:], x[:, : x.shape[1] - shift]
                taps[:, :, tap] = _rows(late).T @ _rows(early)
                inner[:, : x.shape[1] - shift] += late @ kernel[:, :, tap]
        _add(g, f"{name}.weight", taps)
        _add(g, f"{name}.bias", _rows(d).sum(axis=0))
        return inner

    return networks.causal_convolution(w, name, x, dilation), back


def causal_attention(w: Weights, name: str, x: np.ndarray, heads: int) -> tuple[np.ndarray, Back]:
    n, steps, width = x.shape
    apart = lambda y: y.reshape(n, steps, heads, width // heads).transpose(0, 2, 1, 3)
    joined = lambda y: y.transpose(0, 2, 1, 3).reshape(n, steps, width)
    (q, q_back), (k, k_back), (v, v_back) = (affine(w, f"{name}.{p}", x) for p in ("q", "k", "v"))
    q, k, v, scale = apart(q), apart(k), apart(v), 1 / math.sqrt(width // heads)
    score = np.where(np.tri(steps, dtype=bool), q @ k.transpose(0, 1, 3, 2) * scale, -np.inf)
    score = np.exp(score - score.max(axis=-1, keepdims=True))
    share = score / score.sum(axis=-1, keepdims=True)
    out, out_back = affine(w, f"{name}.out", joined(share @ v))

    def back(d: np.ndarray, g: Weights) -> np.ndarray:
        d = apart(out_back(d, g))
        to_share = d @ v.transpose(0, 1, 3, 2)
        to_score = share * (to_share - (to_share * share).sum(axis=-1, keepdims=True)) * scale
        to_q, to_k, to_v = to_score @ k, to_score.transpose(0, 1, 3, 2) @ q, share.transpose(0, 1, 3, 2) @ d
        return q_back(joined(to_q), g) + k_back(joined(to_k), g) + v_back(joined(to_v), g)

    return out, back


def _chain(x: np.ndarray, *layers: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> tuple[np.ndarray, Back]:
    backs = []
    for layer in layers:
        x, back = layer(x)
        backs.append(back)

    def back(d: np.ndarray, g: Weights) -> np.ndarray:
        for b in reversed(backs):
            d = b(d, g)
        return d

    return x, back


def _residual(*layers: Callable[[np.ndarray], tuple[np.ndarray, Back]]) -> Callable[[np.ndarray], tuple[np.ndarray, Back]]:
    def layer(x: np.ndarray) -> tuple[np.ndarray, Back]:
        out, inner = _chain(x, *layers)
        return x + out, lambda d, g: d + inner(d, g)

    return layer


def encode(w: Weights, x: np.ndarray, heads: int) -> tuple[np.ndarray, Back]:
    """networks.encode with its gradient."""
    layers: list = [lambda y: affine(w, "input", y)]
    i = 0
    while (name := f"conv.{i}") + ".conv1.weight" in w:
        steps = [(lambda y, k=k, name=name, i=i: causal_convolution(w, f"{name}.conv{k}", y, 1 << i), lambda y, k=k, name=name: normalized(w, f"{name}.norm{k}", y), gelu) for k in (1, 2)]
        layers.append(_residual(*steps[0], *steps[1]))
        i += 1
    i = 0
    while (name := f"attend.{i}") + ".attention.q.weight" in w:
        layers.append(_residual(lambda y, name=name: normalized(w, f"{name}.norm1", y), lambda y, name=name: causal_attention(w, f"{name}.attention", y, heads)))
        layers.append(_residual(lambda y, name=name: normalized(w, f"{name}.norm2", y), lambda y, name=name: affine(w, f"{name}.widen", y), gelu, lambda y, name=name: affine(w, f"{name}.shrink", y)))
        i += 1
    return _chain(finite(x), *layers, lambda y: normalized(w, "final", y))


def head(w: Weights, name: str, z: np.ndarray) -> tuple[np.ndarray, Back]:
    return _chain(z, lambda y: affine(w, f"{name}.0", y), gelu, lambda y: affine(w, f"{name}.1", y))


def masked_loss(w: Weights, values: np.ndarray, observed: np.ndarray, hidden: np.ndarray, heads: int) -> Loss:
    """Squared errors of the hidden cells, which the model does not see; a hidden cell that was not observed raises."""
    if (hidden & ~observed).any():
        raise ValueError("a cell that was not observed is no target")
    visible = observed & ~hidden
    z, z_back = encode(w, np.concatenate((np.where(visible, values, 0.0), visible), axis=-1), heads)
    out, out_back = head(w, "reconstruct", z)
    gap, g = np.where(hidden, out - values, 0.0), {}
    z_back(out_back(2 * gap, g), g)
    return float((finite(gap) ** 2).sum()), float(hidden.sum()), g


def logistic_loss(logit: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the cross entropy of logits, and its gradient."""
    return float((np.maximum(logit, 0) - logit * label + np.log1p(np.exp(-np.abs(logit)))).sum()), sigmoid(logit) - label


def entity_lstm_loss(w: Weights, x: np.ndarray, static: np.ndarray, label: np.ndarray) -> Loss:
    """Cross entropy of networks.entity_lstm, backwards through all steps; label is (sample, 1)."""
    finite(x), finite(static)
    raw, gate_back = affine(w, "gate", static)
    gate = sigmoid(raw)
    hidden = cell = np.zeros((len(x), gate.shape[1]))
    trail = []
    for step in range(x.shape[1]):
        forget, new, out = (networks.affine(w, f"{n}.x", x[:, step]) + networks.affine(w, f"{n}.h", hidden) for n in ("forget", "cell", "output"))
        forget, new, out, before = sigmoid(forget), np.tanh(new), sigmoid(out), (hidden, cell)
        cell = forget * cell + gate * new
        trail.append((step, forget, new, out, np.tanh(cell), *before))
        hidden = out * np.tanh(cell)
    wide, wide_back = affine(w, "class.0", hidden)
    logit, logit_back = affine(w, "class.1", np.maximum(wide, 0.0))
    total, d = logistic_loss(finite(logit), label)
    g: Weights = {}
    to_hidden, to_cell, to_gate = wide_back(logit_back(d, g) * (wide > 0), g), np.zeros_like(cell), np.zeros_like(gate)
    for step, forget, new, out, bent, hidden_before, cell_before in reversed(trail):
        to_cell = to_cell + to_hidden * out * (1 - bent * bent)
        raw_gates = {"forget": to_cell * cell_before * forget * (1 - forget), "cell": to_cell * gate * (1 - new * new), "output": to_hidden * bent * out * (1 - out)}
        to_gate, to_cell, to_hidden = to_gate + to_cell * new, to_cell * forget, 0.0
        for name, r in raw_gates.items():
            _add(g, f"{name}.x.weight", r.T @ x[:, step])
            _add(g, f"{name}.x.bias", r.sum(axis=0))
            _add(g, f"{name}.h.weight", r.T @ hidden_before)
            to_hidden = to_hidden + r @ w[f"{name}.h.weight"]
    gate_back(to_gate * gate * (1 - gate), g)
    return total, float(len(x)), g
