"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class, given hashed n-gram and skip features of the
tokens before, times that of the token in its class. The TOP most frequent tokens are
dealt to classes by their neighbours and have a second softmax, over hashed features as
well; all other tokens are classed by their last two bytes and have add-one shares inside
their class, an unseen token being one more type of each. The probabilities sum to one.

Counts of tokens cover all training documents and stay in a table; only the HEAD most
frequent go to the workers, for the rest (token, document) pairs are joined with the
table. All training documents are then dealt to parts of about PART tokens, so that the
tasks grow with the table. Weights start from smoothed counts of (feature, class) and
(feature, token) over all parts and are fitted by distributed gradient updates: the parts
of a round descend from the common weights in batches, their changes are averaged block by
block, and the next round's parts go on from there. Every training row takes part once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stash, table, texts

#: Tokens with a softmax of their own, in classes of WIDTH; classes of the other tokens.
TOP, WIDTH, SHAPES = 4096, 64, 32
CLASSES = TOP // WIDTH + SHAPES
#: Tokens at most whose counts are sent to the workers (12 bytes each).
HEAD = 1 << 18
#: Buckets of the class features (token before, pair before, skips of two and three) and of the token feature; row numbers fit in 16 bits.
BUCKETS, INNER = (1 << 12, 1 << 12, 1 << 12, 1 << 12), 1 << 8
#: Training tokens of a part, about; rounds of gradient updates; batches of a part and tokens of a batch, at least and most.
PART, ROUNDS, STEPS, BATCH = 1 << 20, 4, 64, (1 << 10, 1 << 15)
#: Step size, and what the squared gradients of a row start at.
RATE, CALM = 0.1, 10.0
#: Where weights start: pseudo-counts of the class and the token counts, and each class feature's share of its log ratio.
PULL, INNER_PULL, SHARES = 100.0, 100.0, (0.4, 0.4, 0.4, 0.4)
#: Rows of a batch that meet one row of weights: more than so many are summed alone.
LONG = 32
#: Bound of every weight.
LARGEST = 15.0
#: Numbers of one block of weights on its way to the sums.
BLOCK = 1 << 16
END = b"\n"
FOLDS, HELD_OUT = 7, 2


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 7; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def encoded(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape class of every token (an end after each text), and tokens of each text."""
    split = [[*x.lower().split(), END] for x in raw]
    words = [w for x in split for w in x]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    joined = np.frombuffer(b"  " + b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(joined == 32)[2:] if words else np.zeros(0, np.int64)
    last = joined[ends - 1].astype(np.uint32) * np.uint32(0x9E3779B1) + joined[ends - 2].astype(np.uint32) * np.uint32(0x85EBCA77)
    return hashes, (last >> np.uint32(27)).astype(np.int64), np.array([len(x) for x in split], dtype=np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, shape, c): the tokens of all docs, one row each."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 16 << 20):
                h, shape, _ = encoded(texts(piece, "text"))
                found, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(n)], ["h", "shape", "c"])

    counted = docs.select("text").mapInArrow(tally, "h long, shape int, c long")
    return counted.groupBy("h", "shape").agg(F.sum("c").alias("c"))


class Model:
    """Sorted tables of the head's tokens, shares of the rest, and the weights."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, shapes: np.ndarray, total: int, types: int, shape_tokens: np.ndarray, shape_types: np.ndarray) -> None:
        order = np.argsort(head)
        self.head, self.counts, shapes = head[order], counts[order], shapes[order]
        self.total, self.types = total, types
        self.ranked = np.lexsort((self.head, -self.counts))[:TOP]
        self.code = (TOP + shapes).astype(np.uint16)  # rank of a top token, else its shape's class
        self.code[self.ranked] = np.arange(len(self.ranked), dtype=np.uint16)
        # shares of the other tokens: the top ones leave their shape's class
        top_shapes = shapes[self.ranked]
        self.shape_total = shape_tokens - np.bincount(top_shapes, weights=self.counts[self.ranked], minlength=SHAPES) + shape_types - np.bincount(top_shapes, minlength=SHAPES) + 1
        self.place = np.arange(TOP, dtype=np.int32)  # class * WIDTH + slot of each top token
        self.weights = [np.zeros((b, CLASSES), dtype=np.float32) for b in BUCKETS] + [np.zeros((INNER * TOP // WIDTH, WIDTH), dtype=np.float32)]
        self.set_biases()

    def set_biases(self) -> None:
        self.inner_bias = np.full(TOP, -30.0, dtype=np.float32)
        n = self.counts[self.ranked].astype(float)
        mass = np.zeros(CLASSES)
        placed = self.place[: len(n)]
        np.add.at(mass, placed // WIDTH, n)
        mass[TOP // WIDTH :] = self.shape_total
        self.inner_bias[placed] = np.log(n / mass[placed // WIDTH])
        empty = mass == 0
        self.bias = np.where(empty, -30.0, np.log(np.maximum(mass, 1e-9) / mass.sum())).astype(np.float32)
        self.classes = np.concatenate((self.place // WIDTH, TOP // WIDTH + np.arange(SHAPES))).astype(np.int32)  # class of each code

    def look_up(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each token, and its count in the head (-1: not there)."""
        if not len(self.head):
            return (TOP + shape).astype(np.uint16), np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        known = self.head[at] == h
        return np.where(known, self.code[at], TOP + shape).astype(np.uint16), np.where(known, self.counts[at], -1)

    def fitted(self) -> Fitted:
        return Fitted(self.weights, self.bias, self.inner_bias.reshape(-1, WIDTH), self.place, self.classes, np.log(self.shape_total))


class Fitted(NamedTuple):
    """What a worker needs to know of a model once tokens are codes."""

    weights: list[np.ndarray]  # of each class feature (bucket, class), then of the token feature (bucket * classes + class, slot)
    bias: np.ndarray
    inner_bias: np.ndarray
    place: np.ndarray
    classes: np.ndarray
    log_shapes: np.ndarray


def features(codes: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the class features and of the token feature; nothing reaches over a text's start."""
    starts = np.cumsum(lengths) - lengths
    ids = codes.astype(np.uint32)

    def before(d: int) -> np.ndarray:
        out = np.empty(len(ids), dtype=np.uint32)
        out[d:] = ids[: len(ids) - d]
        for k in range(d):  # a text's first d tokens have none; each text has one at least
            at = starts + k
            out[at[lengths > k]] = 65_535 - d
        return out

    def bucket(x: np.ndarray, salt: int, n: int) -> np.ndarray:
        x = (x ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (x >> np.uint32(32 - (n.bit_length() - 1))).astype(np.int32)

    one, two, three = before(1), before(2), before(3)
    return [bucket(one, 1, BUCKETS[0]), bucket(one * np.uint32(0x9E3779B1) + two, 2, BUCKETS[1]), bucket(two, 3, BUCKETS[2]), bucket(three, 4, BUCKETS[3])], bucket(one, 5, INNER)


def inner_rows(fitted: Fitted, codes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the top tokens: where they are, their row of token weights, their slot in it."""
    at = np.flatnonzero(codes < TOP)
    place = fitted.place[codes[at]]
    return at, inner[at] * (TOP // WIDTH) + place // WIDTH, place % WIDTH


def log_probability(fitted: Fitted, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ln of each token's probability, without ln(c + 1) of tokens that are not top.

    In blocks that stay in a core's cache, with the biases folded into one table each;
    weights are at most LARGEST, so no sum of five can overflow an exponential.
    """
    outer, inner = features(codes, lengths)
    first = fitted.weights[0] + fitted.bias
    tokens = (fitted.weights[-1].reshape(INNER, -1, WIDTH) + fitted.inner_bias).reshape(-1, WIDTH)
    klass = fitted.classes[codes]
    step, ones = 2048, np.ones(CLASSES, np.float32)
    x, part, y = np.empty((step, CLASSES), np.float32), np.empty((step, CLASSES), np.float32), np.empty((step, WIDTH), np.float32)
    out = np.empty(len(codes))
    for a in range(0, len(codes), step):
        b = min(a + step, len(codes))
        n = b - a
        now, more = x[:n], part[:n]
        np.take(first, outer[0][a:b], axis=0, out=now, mode="clip")
        for w, f in zip(fitted.weights[1:-1], outer[1:], strict=True):
            np.take(w, f[a:b], axis=0, out=more, mode="clip")
            now += more
        got = now[np.arange(n), klass[a:b]].astype(float)
        np.exp(now, out=now)
        got -= np.log(now @ ones[:CLASSES])
        top, row, slot = inner_rows(fitted, codes[a:b], inner[a:b])
        if len(top):
            z = y[: len(top)]
            np.take(tokens, row, axis=0, out=z, mode="clip")
            chosen = z[np.arange(len(top)), slot].astype(float)
            np.exp(z, out=z)
            got[top] += chosen - np.log(z @ ones[:WIDTH])
        out[a:b] = got
    rest = codes >= TOP
    out[rest] -= fitted.log_shapes[codes[rest] - TOP]
    return out


def run_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of g's rows, taken in `order`, over the runs that begin at `first`: the runs, the longest first, and their sums.

    Short runs all take their k-th rows at once, long ones are summed alone; reduceat goes column by column.
    """
    sizes = np.diff(np.append(first, len(order)))
    rank = np.argsort(-sizes, kind="stable")
    start, size = first[rank], sizes[rank]
    rows = lambda at: np.take(g, at, axis=0, mode="clip")  # noqa: E731  quicker than an index
    out = rows(order[start])
    longer = lambda k: int(np.searchsorted(-size, -k, side="left"))
    alone = longer(LONG)
    for i in range(alone):
        out[i] = rows(order[start[i] : start[i] + size[i]]).sum(axis=0)
    for k in range(1, LONG):
        n = longer(k)
        if n <= alone:
            break
        out[alone:n] += rows(order[start[alone:n] + k])
    return rank, out


def step_rows(w: np.ndarray, power: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """One Adagrad step of the rows that a batch meets, with one rate a row."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # 16 bits sort by counting
    ordered = rows[order]
    first = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    rank, summed = run_sums(g, order, first)
    met = ordered[first[rank]]
    power[met] += np.einsum("ij,ij->i", summed, summed) / summed.shape[1]
    summed *= (RATE / np.sqrt(power[met]))[:, None]
    w[met] = np.take(w, met, axis=0, mode="clip") - summed


def descend(fitted: Fitted, codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The change of the weights by Adagrad over the texts in batches; `fitted` itself stays as it is."""
    weights = [w.copy() for w in fitted.weights]
    power = [np.full(len(w), CALM, dtype=np.float32) for w in weights]  # starts high: rare rows move little
    outer, inner = features(codes, lengths)
    klass = fitted.classes[codes]
    ones = np.ones(CLASSES, np.float32)
    more = np.empty((2048, CLASSES), np.float32)
    batch = min(max(len(codes) // STEPS, BATCH[0]), BATCH[1])
    for a in range(0, len(codes), batch):
        b = min(a + batch, len(codes))
        g = np.empty((b - a, CLASSES), dtype=np.float32)
        for i in range(a, b, 2048):
            j = min(i + 2048, b)
            now, part = g[i - a : j - a], more[: j - i]
            np.take(weights[0], outer[0][i:j], axis=0, out=now, mode="clip")
            for w, f in zip(weights[1:-1], outer[1:], strict=True):
                np.take(w, f[i:j], axis=0, out=part, mode="clip")
                now += part
            now += fitted.bias
            np.exp(now, out=now)
            now /= (now @ ones[:CLASSES])[:, None]
            now[np.arange(j - i), klass[i:j]] -= 1
        for w, p, f in zip(weights[:-1], power[:-1], outer, strict=True):
            step_rows(w, p, f[a:b], g)
        top, row, slot = inner_rows(fitted, codes[a:b], inner[a:b])
        if len(top):
            g = np.take(weights[-1], row, axis=0, mode="clip")
            g += np.take(fitted.inner_bias, row % (TOP // WIDTH), axis=0, mode="clip")
            np.exp(g, out=g)
            g /= (g @ ones[:WIDTH])[:, None]
            g[np.arange(len(top)), slot] -= 1
            step_rows(weights[-1], power[-1], row, g)
    return [w - o for w, o in zip(weights, fitted.weights, strict=True)]


def joint_counts(fitted: Fitted, codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """How often each bucket of a feature goes with each class, and with each slot of a class."""
    outer, inner = features(codes, lengths)
    klass = fitted.classes[codes]
    found = [np.bincount(f * CLASSES + klass, minlength=b * CLASSES) for f, b in zip(outer, BUCKETS, strict=True)]
    _, row, slot = inner_rows(fitted, codes, inner)
    return [*found, np.bincount(row * WIDTH + slot, minlength=INNER * TOP)]


def start_weights(model: Model, counts: list[np.ndarray]) -> None:
    """Set the weights from counts, smoothed towards the biases."""
    share = np.exp(model.bias.astype(float))
    for w, n, part in zip(model.weights[:-1], counts[:-1], SHARES, strict=True):
        n = n.reshape(w.shape)
        w[:] = part * np.log((n + PULL * share) / ((n.sum(axis=1, keepdims=True) + PULL) * share))
    w, n = model.weights[-1], counts[-1].reshape(-1, WIDTH)
    inside = np.exp(np.tile(model.inner_bias.reshape(-1, WIDTH), (INNER, 1)).astype(float))
    w[:] = np.log((n + INNER_PULL * inside) / ((n.sum(axis=1, keepdims=True) + INNER_PULL) * inside))
    for w in model.weights:
        np.clip(w, -LARGEST, LARGEST, out=w)


_CODED = "rid long, doc_id long, n_tokens long, n_known long, log_counts double, rest_counts double, codes binary, tail array<struct<h:long,tf:int>>"


def coded_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every text as codes of two bytes a token, with what the head knows of its counts, and the tokens that it does not know."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                h, shape, lengths = encoded(texts(piece, "text"))
                n = len(lengths)
                doc = np.repeat(np.arange(n), lengths)
                unique, first, back = np.unique(h, return_index=True, return_inverse=True)
                codes, count = (x[back] for x in m.look_up(unique, shape[first]))
                in_head = count >= 0
                log_count = np.where(in_head, np.log(np.maximum(count, 0) + 1.0), 0.0)
                key = np.sort((doc[~in_head].astype(np.int64) << 32) | back[~in_head])
                pairs, tf = np.unique(key, return_counts=True)
                sizes = np.concatenate(([0], np.cumsum(np.bincount(pairs >> 32, minlength=n))))
                structs = pa.StructArray.from_arrays([pa.array(unique[pairs & 0xFFFFFFFF].view(np.int64)), pa.array(tf.astype(np.int32))], ["h", "tf"])
                total = lambda x: np.bincount(doc, weights=x, minlength=n)
                ends = np.concatenate(([0], np.cumsum(2 * lengths)))
                binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(lengths), pa.array(total(in_head).astype(np.int64)), pa.array(total(log_count)), pa.array(total(np.where(codes < TOP, 0.0, log_count))), binary, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs)],
                    [x.split()[0] for x in _CODED.split(", ")[:-1]] + ["tail"],
                )

    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, _CODED)


def code_pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with `codes`, their codes as one array and the tokens of each text."""
    for batch in batches:
        for piece in slices(batch, "codes", most):
            raw = piece.column(piece.schema.get_field_index("codes")).to_pylist()
            yield piece, np.frombuffer(b"".join(raw), dtype=np.uint16), np.array([len(x) // 2 for x in raw], dtype=np.int64)


def neighbours(coded: DataFrame) -> np.ndarray:
    """How often each top token follows each of the 128 most frequent ones."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TOP * 128, dtype=np.int64)
        for _, codes, _ in code_pieces(batches):
            here, before = codes[1:].astype(np.int64), codes[:-1]
            good = (here < TOP) & (before < 128)
            sums += np.bincount(here[good] * 128 + before[good], minlength=len(sums))
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], ["cell", "n"])

    rows = coded.select("codes").mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # TOP * 128 cells at most
    out = np.zeros(TOP * 128)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(TOP, 128)


def deal_classes(model: Model, follows: np.ndarray) -> None:
    """Group the top tokens by what they follow (k-means), then cut the groups into classes."""
    rows = np.sqrt(follows + 0.05)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centres = rows[:8].copy()
    for _ in range(15):
        group = (rows @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (group == k).any():
                mean = rows[group == k].mean(axis=0)
                centres[k] = mean / np.linalg.norm(mean)
    order = np.lexsort((np.arange(TOP), group))
    model.place[order] = np.arange(TOP, dtype=np.int32)
    model.set_biases()


_BLOCKS = "block int, part int, numbers binary"
_SUMMED = "block int, n long, values binary"


def as_blocks(arrays: list[np.ndarray], part: int, kind: type) -> list[tuple[int, int, bytes]]:
    """One array's numbers after the other's, cut into blocks."""
    flat = np.concatenate([x.ravel() for x in arrays]).astype(kind)
    return [(i, part, flat[a : a + BLOCK].tobytes()) for i, a in enumerate(range(0, len(flat), BLOCK))]


def block_sums(rows: DataFrame, kind: type, parts: int) -> tuple[list[np.ndarray], int]:
    """Sums of all parts' arrays, and how many parts there are.

    In two levels: each block's parts are summed in some sqrt(parts) groups, then the
    groups' sums, so no task meets more than that many of either.
    """
    groups = max(1, math.isqrt(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, total = None, 0, None
        for batch in batches:
            done = []
            for now, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if now != block:
                    if block is not None:
                        done.append((block, n, total.tobytes()))
                    block, n, total = now, 0, 0.0
                n, total = n + 1, total + np.frombuffer(raw.as_buffer(), dtype=kind).astype(np.float64)
            yield summed(done)
        yield summed([(block, n, total.tobytes())] if block is not None else [])

    def add_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for block, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                k, total = found.get(block, (0, 0.0))
                found[block] = k + n, total + np.frombuffer(raw.as_buffer(), dtype=np.float64)
        yield summed([(block, n, total.tobytes()) for block, (n, total) in sorted(found.items())])

    def summed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["block", "n", "values"])

    # a group is keyed with its block: a task's rows come sorted, one sum at a time
    keyed = rows.withColumn("group", F.pmod("part", F.lit(groups)))
    first = keyed.repartition("block", "group").sortWithinPartitions("block", "group").select("block", "group", "numbers").mapInArrow(add, _SUMMED)
    found = first.repartition("block").mapInArrow(add_again, _SUMMED).toArrow().sort_by("block")  # of the weights' size
    shapes = [(b, CLASSES) for b in BUCKETS] + [(INNER * TOP // WIDTH, WIDTH)]
    if not found.num_rows:
        return [np.zeros(x) for x in shapes], 0
    flat, out, at = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in found["values"]]), [], 0
    for x in shapes:
        out.append(flat[at : at + x[0] * x[1]].reshape(x))
        at += x[0] * x[1]
    return out, found["n"][0].as_py()


def head_model(vocabulary: DataFrame) -> Model:
    """A model of no weights yet, from the stashed vocabulary of the training docs."""
    summed = vocabulary.agg(F.sum("c"), F.count("*")).first()
    total, types = summed[0] or 0, summed[1]
    level = F.floor(F.log2("c")).cast("int")
    sizes = {r["level"]: r["count"] for r in vocabulary.groupBy(level.alias("level")).count().collect()}  # 64 rows at most
    least, held = 62, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > HEAD:
            break
        least, held = k, held + sizes[k]
    head = vocabulary.filter(F.col("c") >= F.lit(1 << least)).toArrow()  # HEAD rows at most
    shapes = vocabulary.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("types")).toPandas()
    tokens, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    tokens[shapes["shape"]], kinds[shapes["shape"]] = shapes["n"], shapes["types"]
    model = Model(head["h"].to_numpy().view(np.uint64), head["c"].to_numpy(), head["shape"].to_numpy().astype(np.int64), total, types, tokens, kinds)
    model.least = 1 << least
    return model


def fit(train: DataFrame, model: Model) -> None:
    """Fit the model's classes and weights on all coded training texts (rid, n_tokens, codes)."""
    spark = train.sparkSession
    deal_classes(model, neighbours(train))
    shared = spark.sparkContext.broadcast(model.fitted())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, codes, lengths in code_pieces(batches, 1 << 20):
            found = joint_counts(shared.value, codes, lengths)
            sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
        if sums is not None:
            me = TaskContext.get().partitionId()
            for block, _, raw in as_blocks(sums, me, np.int64):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([me], pa.int32()), pa.array([raw], pa.binary())], ["block", "part", "numbers"])

    parts = max(1, round(model.total / PART / ROUNDS)) * ROUNDS
    dealt = train.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int"))
    counts, _ = block_sums(train.select("codes").coalesce(max(1, parts)).mapInArrow(tally, _BLOCKS), np.int64, parts)
    shared.destroy()
    start_weights(model, counts)

    def learn(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf.sort_values("rid")["codes"].tolist()
        changes = descend(current.value, np.frombuffer(b"".join(raw), dtype=np.uint16), np.array([len(x) // 2 for x in raw], dtype=np.int64))
        return pd.DataFrame(as_blocks(changes, int(key[0]), np.float16), columns=["block", "part", "numbers"])

    for k in range(ROUNDS):
        current = spark.sparkContext.broadcast(model.fitted())
        mine = dealt.filter(F.pmod("part", F.lit(ROUNDS)) == k).select("part", "rid", "codes")
        changes, n = block_sums(mine.groupBy("part").applyInPandas(learn, _BLOCKS), np.float16, parts)
        for w, change in zip(model.weights, changes, strict=True):
            w += (change / max(n, 1)).astype(np.float32)
            np.clip(w, -LARGEST, LARGEST, out=w)
        current.destroy()


def coded_scores(coded: DataFrame, model: Model) -> DataFrame:
    """rid (as r) and ln of each coded text's probability, without the counts of tokens that are not top."""
    shared = coded.sparkSession.sparkContext.broadcast(model.fitted())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, codes, lengths in code_pieces(batches, 1 << 20):
            ln = log_probability(shared.value, codes, lengths)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            kept = [piece.column(piece.schema.get_field_index(c)) for c in _KEPT]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.bincount(doc, weights=ln, minlength=len(lengths)))], [*_KEPT, "ln"])

    kinds = {x.split()[0]: x for x in _CODED.split(", ")[:-1]}
    return coded.select(*_KEPT, "codes").mapInArrow(score, ", ".join(kinds[c] for c in _KEPT) + ", ln double")


_KEPT = ["rid", "doc_id", "n_tokens", "n_known", "log_counts", "rest_counts"]


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts have the end token alone. A null doc_id belongs to fold 0.
    Repeated rows count and are scored each; tokens of equal counts are ranked by their
    hashes; an empty table, or one without training rows, leaves a model of no tokens.
    Columns other than doc_id and text are not read. A very long text is one row of one
    part; memory follows it.
    """
    train = docs.filter(fold() != HELD_OUT).select("doc_id", "text")
    vocabulary = stash(count_tokens(train), "vocabulary")
    model = head_model(vocabulary)
    coded = stash(coded_documents(docs.select("doc_id", "text"), model), "coded")
    fit(coded.filter(fold() != HELD_OUT).select("rid", "codes"), model)
    rare = vocabulary.filter(F.col("c") < F.lit(model.least)).select(F.col("h").alias("of"), "c")
    met = coded.select("rid", F.inline("tail")).join(rare, F.col("h") == F.col("of"), "left")
    sums = met.groupBy(F.col("rid").alias("r")).agg(F.sum(F.col("tf") * F.ln(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("seen"))
    ten = float(np.log(10.0))
    more = F.coalesce("more", F.lit(0.0))
    base = (F.col("log_counts") + more) / ten - F.col("n_tokens") * float(np.log10(model.total + model.types + 1.0))
    return coded_scores(coded, model).join(sums, F.col("rid") == F.col("r"), "left").select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"), base.alias("base_score"), ((F.col("ln") + F.col("rest_counts") + more) / ten).alias("score"),
    )


def op3_maxent(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every row of `documents`."""
    return language_model_scores(table(spark, sf_dir, "documents"))
