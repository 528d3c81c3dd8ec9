"""Training of sequence models by distributed gradients: exact sums over rows, early stopping, checkpoints.

Rows are written once, in blocks by a hash of their key, so an update reads one block and
an epoch reads the table once. A task sums its rows' gradients, tasks' sums are added in
slots, and the driver, which holds nothing but the weights, takes the step. A lost executor
costs the tasks of one update.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import written
from tidemark.operators.gradients import Loss
from tidemark.operators.networks import Weights, stacked

#: Numbers that a model may have: 16 slots of them come to the driver in an update.
MOST_NUMBERS = 1 << 20
SLOTS = 16


@dataclass(frozen=True)
class Settings:
    """Steps are those of Adam with decoupled decay."""

    epochs: int = 10
    patience: int = 3
    least_gain: float = 1e-4
    rate: float = 1e-2
    decay: float = 1e-2
    blocks: int = 4

    def __post_init__(self) -> None:
        if min(self.epochs, self.patience, self.blocks) < 1 or not self.rate > 0 or self.decay < 0 or self.least_gain < 0:
            raise ValueError("epochs, patience and blocks must be 1 or more, the rate positive, decay and gain not negative")


@dataclass(frozen=True)
class Epoch:
    epoch: int
    train_loss: float
    validation_loss: float


@dataclass(frozen=True)
class Trained:
    weights: Weights
    best_epoch: int
    trace: list[Epoch]


def flat(w: Weights, names: list[str]) -> np.ndarray:
    return np.concatenate([np.ravel(w[n]) for n in names])


def shaped(vector: np.ndarray, like: Weights, names: list[str]) -> Weights:
    ends = np.cumsum([like[n].size for n in names])[:-1]
    return {n: v.reshape(like[n].shape) for n, v in zip(names, np.split(vector, ends), strict=True)}


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")  # sums of doubles depend on their order
    total = functools.reduce(operator.add, map(np.frombuffer, rows["gradient"]))
    return pd.DataFrame({"slot": rows["slot"].iloc[:1], "loss": [rows["loss"].sum()], "count": [rows["count"].sum()], "gradient": [total.tobytes()]})


def gradient(rows: DataFrame, weights: Weights, loss: Callable[..., Loss], columns: tuple[str, ...]) -> tuple[float, float, np.ndarray]:
    """(sum of the loss, its count, gradient of the sum by sorted names of weights) over all rows."""
    names = sorted(weights)
    size = sum(v.size for v in weights.values())
    if size > MOST_NUMBERS:
        raise ValueError(f"a model of {size} numbers is not trained here")
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, vector, task = 0.0, 0.0, np.zeros(size), None
        for batch in batches:
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
            for _, arrays in stacked(batch, 1):
                more, n, g = loss(held.value, *arrays)
                total, count = total + more, count + n
                vector += np.concatenate([np.ravel(g[name]) if name in g else np.zeros(held.value[name].size) for name in names])
        if task is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([task % SLOTS]), pa.array([total]), pa.array([count]), pa.array([vector.tobytes()], pa.binary())], ["task", "slot", "loss", "count", "gradient"])

    parts = rows.select(F.spark_partition_id().cast("long").alias("task"), *columns).mapInArrow(summed, "task long, slot long, loss double, count double, gradient binary")
    slots = sorted(parts.groupBy("slot").applyInPandas(_added, "slot long, loss double, count double, gradient binary").collect(), key=lambda r: r["slot"])
    held.unpersist()
    vector = sum((np.frombuffer(r["gradient"]) for r in slots), np.zeros(size))
    if not np.isfinite(vector).all():
        raise ValueError("a gradient is not finite")
    return sum(r["loss"] for r in slots), sum(r["count"] for r in slots), vector


class _Adam:
    def __init__(self, size: int, settings: Settings):
        self.mean, self.square, self.steps, self.settings = np.zeros(size), np.zeros(size), 0, settings

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient * gradient
        move = (self.mean / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.999**self.steps)) + 1e-8)
        return at * (1 - self.settings.rate * self.settings.decay) - self.settings.rate * move


def train(samples: DataFrame, weights: Weights, loss: Callable[[int], Callable[..., Loss]], columns: tuple[str, ...], settings: Settings, key: str = "sample") -> Trained:
    """The weights of the epoch with the least validation loss, and every epoch's losses.

    samples have `validation` (boolean, null raises), `key` and the loss's columns.
    loss(epoch) is the loss of an epoch's updates, loss(0) that of validation. An epoch is an update for
    each block; its training loss is the mean of the blocks' means, taken before each
    update. Training ends when `patience` epochs in a row gain less than `least_gain`, but
    not in the first epoch. A side without a target raises. Of a null key, rows go to one block.
    """
    if min(map(len, (weights, columns))) < 1:
        raise ValueError("a model needs weights and columns")
    told = F.when(F.col("validation").isNull(), F.raise_error(F.lit("validation is null")).cast("int")).when(F.col("validation"), -1)
    blocks = told.otherwise(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(settings.blocks)).cast("int"))
    rows = written(samples.select(blocks.alias("block"), *columns), "training", by="block")
    names = sorted(weights)
    at, adam, trace = flat(weights, names), _Adam(sum(v.size for v in weights.values()), settings), []
    best, best_loss, best_epoch, idle = at, float("inf"), 1, 0
    for epoch in range(1, settings.epochs + 1):
        losses = []
        for block in range(settings.blocks):
            total, count, vector = gradient(rows.filter(F.col("block") == block), shaped(at, weights, names), loss(epoch), columns)
            if count:
                losses.append(total / count)
                at = adam.step(at, vector / count)
        total, count, _ = gradient(rows.filter(F.col("block") == -1), shaped(at, weights, names), loss(0), columns)
        if not losses or not count:
            raise ValueError("training and validation need a target each")
        trace.append(Epoch(epoch, sum(losses) / len(losses), total / count))
        if trace[-1].validation_loss < best_loss - settings.least_gain:
            best, best_loss, best_epoch, idle = at, trace[-1].validation_loss, epoch, 0
        else:
            idle += 1
            if epoch >= 2 and idle >= settings.patience:
                break
    return Trained(shaped(best, weights, names), best_epoch, trace)


def _digest(name: str, shape: list[int], values: bytes) -> str:
    return hashlib.sha256(f"{name}:{','.join(map(str, shape))}:".encode() + values).hexdigest()


def save(spark: SparkSession, weights: Weights, path: str) -> None:
    """A row for each array of the model: name, shape, doubles in little-endian bytes, SHA-256. An existing path raises."""
    rows = [(n, list(weights[n].shape), bytearray(np.ascontiguousarray(weights[n], "<f8").tobytes())) for n in sorted(weights)]
    rows = [(*r, _digest(r[0], r[1], bytes(r[2]))) for r in rows]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers binary, sha256 string").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str, expected: dict[str, tuple[int, ...]]) -> Weights:
    """A saved model; an array whose digest does not hold, or names and shapes other than the expected ones, raise by name."""
    found: Weights = {}
    for r in spark.read.parquet(path).limit(len(expected) + 1).collect():
        if _digest(r["name"], r["shape"], bytes(r["numbers"])) != r["sha256"]:
            raise ValueError(f"array {r['name']} was changed")
        found[r["name"]] = np.frombuffer(bytes(r["numbers"]), "<f8").reshape(r["shape"])
    wrong = sorted(n for n in found.keys() | expected.keys() if n not in found or n not in expected or found[n].shape != tuple(expected[n]))
    if wrong:
        raise ValueError(f"arrays do not fit the model: {', '.join(wrong)}")
    return found


def drawn_mask(seed: int, sample: np.ndarray, observed: np.ndarray, rate: float) -> np.ndarray:
    """Each observed cell with probability `rate` by a hash of seed, sample and cell; where that meets none, the one of the least draw."""
    with np.errstate(over="ignore"):
        place = np.arange(observed[0].size, dtype=np.uint64).reshape(observed.shape[1:])
        x = sample.astype(np.int64).astype(np.uint64).reshape(-1, *[1] * (observed.ndim - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        for add in (place, np.uint64(0)):  # a 64-bit mixer twice: over the sample, then over the cell
            x = x + add * np.uint64(0xD1B54A32D192ED03)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    draw = np.where(observed, (x >> np.uint64(11)).astype(float) / float(1 << 53), 2.0)
    least = draw.reshape(len(draw), -1).min(axis=1).reshape(-1, *[1] * (observed.ndim - 1))
    return observed & ((draw < rate) | (draw == least) & (least >= rate))
