"""Corruption masks and forward passes over daily windows of the sites: channels are the kinds of events."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.shared import shared_path, written
from tidemark.operators import corruption, gradients, networks, training
from tidemark.sources.views import CALENDAR, observations

#: Spread of the weights below. No trained weights are published; these stand for them.
SPREAD, WIDTH, HIDDEN, HEADS = 0.3, 16, 8, 2
RATE, SPAN, SEED = 0.2, 12, 11
#: How a site's errors are told.
HOW = ("mean", "max", "tail")
#: Days whose mean is the label, share of cells that masked training hides, and how long both models are trained.
WEEK, MASKED, FIT = 7, 0.25, training.Settings(epochs=4, patience=2, blocks=2)


def cells(spark, sf_dir):
    """Every site, day of the calendar (t) and kind of event: its mean value, or none observed."""
    rows = observations(spark, sf_dir).withColumn("t", F.datediff(F.to_date("ts"), F.lit(CALENDAR[0]).cast("date")))
    n = F.datediff(F.lit(CALENDAR[1]).cast("date"), F.lit(CALENDAR[0]).cast("date"))
    daily = rows.groupBy(F.col("site").alias("sample"), "t", F.col("kind").alias("channel")).agg((F.sum("value") / F.count("*")).cast("double").alias("value"))
    kinds = rows.agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # the few kinds of events
    grid = rows.select(F.col("site").alias("sample")).distinct().crossJoin(F.broadcast(kinds))
    grid = grid.select("sample", F.explode("kinds").alias("channel")).select("sample", "channel", F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))
    return grid.join(daily, ["sample", "t", "channel"], "left").withColumn("observed", F.col("value").isNotNull())


def nn_corrupt(spark, sf_dir):
    """What each mode hides of every site's window."""
    mode = F.element_at(F.array(*map(F.lit, (*corruption.MODES, "mixed"))), (F.col("sample") % 4 + 1).cast("int"))
    out = corruption.corruption(cells(spark, sf_dir), mode, RATE, SPAN, SEED)
    return out.filter("hidden").select("sample", F.col("t").cast("long").alias("t"), "channel", "mode")


def windows(spark, sf_dir):
    """(sample, x, seen, static) of each site: steps of channels, scaled; static are two shares of its cells."""
    x = (F.col("value") - 50) / 30
    rows = cells(spark, sf_dir).groupBy("sample", "t").agg(F.array_sort(F.collect_list(F.struct("channel", F.coalesce(x, F.lit(0.0)).alias("x"), "observed"))).alias("c"))
    steps = rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("s"))
    each = lambda f: F.transform("s", lambda s: F.transform(s["c"], lambda c: c[f]))
    flat = F.flatten(each("observed"))
    share = F.size(F.filter(flat, lambda o: o)) / F.size(flat)
    latest = F.size(F.filter(F.flatten(F.slice(each("observed"), -7, 7)), lambda o: o)) / (7 * F.size(F.element_at("s", -1)["c"]))
    return steps.select("sample", each("x").alias("x"), each("observed").alias("seen"), F.array(share, latest).alias("static"))


def drawn(shapes: dict[str, tuple[int, ...]]) -> networks.Weights:
    """Weights from a seed and their names' order; norms start at one and zero."""
    rng = np.random.default_rng(SEED)
    return {n: np.ones(s) if ".norm" in n + "." and n.endswith("weight") and len(s) == 1 else SPREAD * rng.standard_normal(s) for n, s in shapes.items()}


def encoder_shapes(channels: int, width: int, layers: int = 2, attend: int = 1) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {"input.weight": (width, channels), "input.bias": (width,), "final.weight": (width,), "final.bias": (width,)}
    for i in range(layers):
        for k in (1, 2):
            out |= {f"conv.{i}.conv{k}.weight": (width, width, 3), f"conv.{i}.conv{k}.bias": (width,), f"conv.{i}.norm{k}.weight": (width,), f"conv.{i}.norm{k}.bias": (width,)}
    for i in range(attend):
        out |= {f"attend.{i}.norm{k}.{p}": (width,) for k in (1, 2) for p in ("weight", "bias")}
        out |= {f"attend.{i}.attention.{p}.weight": (width, width) for p in "qkv"} | {f"attend.{i}.attention.out.weight": (width, width)}
        out |= {f"attend.{i}.attention.{p}.bias": (width,) for p in (*"qkv", "out")}
        out |= {f"attend.{i}.widen.weight": (2 * width, width), f"attend.{i}.widen.bias": (2 * width,), f"attend.{i}.shrink.weight": (width, 2 * width), f"attend.{i}.shrink.bias": (width,)}
    return out


def head_shapes(name: str, width: int, out: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.0.weight": (width, width), f"{name}.0.bias": (width,), f"{name}.1.weight": (out, width), f"{name}.1.bias": (out,)}


def lstm_shapes(channels: int, static: int, hidden: int) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {"gate.weight": (hidden, static), "gate.bias": (hidden,)}
    for g in ("forget", "cell", "output"):
        out |= {f"{g}.x.weight": (hidden, channels), f"{g}.x.bias": (hidden,), f"{g}.h.weight": (hidden, hidden)}
    return out | {"class.0.weight": (hidden, hidden), "class.0.bias": (hidden,), "class.1.weight": (1, hidden), "class.1.bias": (1,)}


def _channels(samples) -> int:
    first = samples.select(F.size(F.element_at("x", 1)).alias("n")).first()
    return first["n"] if first else 1


def nn_ealstm(spark, sf_dir):
    """Logits of the entity-aware LSTM for every site's window."""
    samples = written(windows(spark, sf_dir), "windows")
    w = drawn(lstm_shapes(_channels(samples), 2, HIDDEN))
    return networks.applied(samples, w, networks.entity_lstm, ("x", "static")).withColumn("score", F.round("score", 9))


def nn_tcn(spark, sf_dir):
    """The causal encoder's forecast at the last day of every site's window."""
    samples = written(windows(spark, sf_dir), "windows")
    w = drawn(encoder_shapes(_channels(samples), WIDTH) | head_shapes("forecast", WIDTH, 1))
    return networks.applied(samples, w, _forecast, ("x",)).withColumn("score", F.round("score", 9))


def _forecast(w, x):
    return networks.forecast(w, x, HEADS)[:, 0]


def nn_score_a(spark, sf_dir):
    """How badly each site's channels are rebuilt from its others: mean over days, worst day and last day."""
    samples = written(windows(spark, sf_dir), "windows")
    n = _channels(samples)
    w = drawn(encoder_shapes(2 * n, WIDTH) | head_shapes("reconstruct", WIDTH, n))
    scores = networks.applied(samples, w, _scores, ("x", "seen"), names=HOW)  # all three of one rebuilding
    return scores.select("sample", F.inline(F.array(*[F.struct(F.lit(how).alias("how"), F.round(how, 9).alias("score")) for how in HOW])))


def _scores(w, x, seen):
    steps = networks.step_errors(w, x, seen, HEADS)
    return np.stack([networks.summarized(steps, seen, how) for how in HOW], axis=1)


class _Score:
    def __init__(self, how: str):
        self.how = how

    def __call__(self, w, x, seen):
        return networks.reconstruction_score(w, x, seen, self.how, HEADS)


class _Lstm:
    """Cross entropy of every epoch; steps are relative to a window's first."""

    def __call__(self, epoch: int):
        return self.loss

    @staticmethod
    def loss(w, x, static, label):
        return gradients.entity_lstm_loss(w, x - x[:, :1], static, label)


class _Masked:
    """Squared error of cells that an epoch's draw hides, another draw each epoch."""

    def __call__(self, epoch: int):
        return functools.partial(self.loss, SEED + epoch * 1000)

    @staticmethod
    def loss(seed, w, x, seen, sample):
        return gradients.masked_loss(w, x, seen, training.drawn_mask(seed, sample[:, 0], seen, MASKED), HEADS)


def labelled(spark, sf_dir):
    """Windows but for their last week, whether that week's observed values have a mean above 50, and which sites are for validation."""
    rows = windows(spark, sf_dir)
    kept = lambda c: F.expr(f"slice({c}, 1, size({c}) - {WEEK})").alias(c)
    last = F.flatten(F.slice("x", -WEEK, WEEK))  # a missing cell is 0, the scaled mean of 50
    label = (F.aggregate(last, F.lit(0.0), lambda a, v: a + v) > 0).cast("double")
    return rows.select("sample", kept("x"), kept("seen"), "static", F.array(label).alias("label"), F.array(F.col("sample").cast("double")).alias("id"), (F.pmod(F.col("sample"), F.lit(5)) == 0).alias("validation"))


def trained_lstm(samples):
    w = drawn(lstm_shapes(_channels(samples), 2, HIDDEN))
    return training.train(samples, w, _Lstm(), ("x", "static", "label"), FIT)


def nn_train(spark, sf_dir):
    """Losses of both models' training by epoch: the entity-aware LSTM and the masked reconstruction."""
    samples = written(labelled(spark, sf_dir), "labelled")
    n = _channels(samples)
    masked = training.train(samples, drawn(encoder_shapes(2 * n, WIDTH) | head_shapes("reconstruct", WIDTH, n)), _Masked(), ("x", "seen", "id"), FIT)
    rows = [(name, e.epoch, round(e.train_loss, 6), round(e.validation_loss, 6), e.epoch == t.best_epoch) for name, t in (("ealstm", trained_lstm(samples)), ("masked", masked)) for e in t.trace]
    return spark.createDataFrame(rows, "model string, epoch int, train_loss double, validation_loss double, best boolean")


def nn_replay(spark, sf_dir):
    """A trained model saved, read back and run again: every site's probability by both, and whether they are the same."""
    samples = written(labelled(spark, sf_dir), "labelled")
    t, path = trained_lstm(samples), shared_path(spark, "model")
    training.save(spark, t.weights, path)
    again = training.load(spark, path, {n: v.shape for n, v in t.weights.items()})
    first, second = (networks.applied(samples, w, _relative_lstm, ("x", "static")) for w in (t.weights, again))
    p = lambda c: F.round(1 / (1 + F.exp(-F.col(c))), 6)
    rows = first.join(second.withColumnRenamed("score", "replayed"), "sample").join(samples.select("sample", "label", "validation"), "sample")
    return rows.select("sample", "validation", F.element_at("label", 1).cast("int").alias("label"), p("score").alias("p"), p("replayed").alias("p_replayed"), (F.col("score") == F.col("replayed")).alias("same"))


def _relative_lstm(w, x, static):
    return networks.entity_lstm(w, x - x[:, :1], static)


_U = "(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) / 4294967296.0)"
_CELLS = """
daily AS (SELECT user_id AS sample, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, event_type AS channel, count(*) AS n FROM events GROUP BY ALL),
cells AS (
  SELECT s.sample, t.t, k.channel, d.n IS NOT NULL AS observed
  FROM (SELECT DISTINCT user_id AS sample FROM events) s CROSS JOIN (SELECT DISTINCT event_type AS channel FROM events) k CROSS JOIN (SELECT unnest(range(0, 30)) AS t) t
  LEFT JOIN daily d ON d.sample = s.sample AND d.t = t.t AND d.channel = k.channel)"""

QUERIES = {f.__name__: f for f in (nn_corrupt, nn_ealstm, nn_tcn, nn_score_a, nn_train, nn_replay)}
SQL = {
    "nn_corrupt": f"""WITH {_CELLS},
told AS (
  SELECT *, CASE sample % 4 WHEN 0 THEN 'random' WHEN 1 THEN 'channel' WHEN 2 THEN 'span' ELSE ['random', 'channel', 'span'][CAST(floor({_U.format(f"'{SEED}:mode:' || sample")} * 3) AS INTEGER) + 1] END AS mode,
    {_U.format(f"'{SEED}:cell:' || sample || ':' || t || ':' || channel")} AS draw, {_U.format(f"'{SEED}:channel:' || sample || ':' || channel")} AS turn,
    CAST(floor({_U.format(f"'{SEED}:span:' || sample")} * {30 - SPAN + 1}) AS INTEGER) AS start FROM cells),
bounds AS (SELECT *, min(draw) FILTER (observed) OVER w AS least, min(turn) FILTER (observed) OVER w AS chosen FROM told WINDOW w AS (PARTITION BY sample)),
drawn AS (SELECT *, observed AND CASE mode WHEN 'random' THEN draw < {RATE} WHEN 'channel' THEN turn = chosen ELSE t >= start AND t < start + {SPAN} END AS d FROM bounds),
met AS (SELECT *, bool_or(d) OVER (PARTITION BY sample) AS met FROM drawn)
SELECT sample, t, channel, mode FROM met WHERE d OR (NOT met AND observed AND draw = least)""",
}
