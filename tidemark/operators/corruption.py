"""Corruption masks over observed cells: random, channel, span and mixed, never empty, never outside what was observed.

Draws are hashes of (seed, sample, cell), so a mask is the same on every run and every
partitioning, and SQL can tell it. Cells of a sample (its times and channels) are a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("random", "channel", "span")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) drawn from the first 32 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def corruption(cells: DataFrame, mode: Column | str, rate: float = 0.2, span: int = 12, seed: int = 11) -> DataFrame:
    """cells (sample, t from 0, channel, observed) with `mode` and `hidden`.

    random: each observed cell with probability `rate`. channel: one channel that has an
    observation, whole. span: `span` neighbouring times of all channels, the whole sample
    if it is shorter. mixed: one of the three a sample. Where a draw meets no observed cell,
    the observed cell with the least draw is hidden; a sample without any has nothing
    hidden. An unknown mode raises, as do a rate outside (0, 1) and a span below 1.
    """
    if not 0 < rate < 1 or span < 1:
        raise ValueError("the rate must lie in (0, 1), the span be 1 or more")
    mode = F.lit(mode) if isinstance(mode, str) else mode
    s, t, c = F.col("sample"), F.col("t"), F.col("channel")
    pick = F.floor(uniform(seed, F.lit("mode"), s) * len(MODES)).cast("int")
    told = F.when(mode == "mixed", F.element_at(F.array(*map(F.lit, MODES)), pick + 1)).otherwise(mode)
    told = F.when(told.isin(*MODES), told).otherwise(F.raise_error(F.concat(F.lit("unknown corruption mode "), F.coalesce(told, F.lit("null")))))
    of = Window.partitionBy("sample")
    seen = F.coalesce("observed", F.lit(False))
    rows = cells.withColumns({"mode": told, "draw": uniform(seed, F.lit("cell"), s, t, c), "turn": uniform(seed, F.lit("channel"), s, c)})
    rows = rows.withColumns({"least": F.min(F.when(seen, F.col("draw"))).over(of), "chosen": F.min(F.when(seen, F.col("turn"))).over(of), "length": F.max("t").over(of) + 1})
    start = F.floor(uniform(seed, F.lit("span"), s) * F.greatest(F.lit(1), F.col("length") - span + 1))
    drawn = (
        F.when(F.col("mode") == "random", F.col("draw") < rate).when(F.col("mode") == "channel", F.col("turn") == F.col("chosen"))
        .otherwise((t >= start) & (t < start + span))
    )
    rows = rows.withColumn("drawn", seen & drawn)
    rows = rows.withColumn("any", F.bool_or("drawn").over(of))
    hidden = F.col("drawn") | (~F.col("any") & seen & (F.col("draw") == F.col("least")))
    return rows.select(*cells.columns, "mode", hidden.alias("hidden"))
