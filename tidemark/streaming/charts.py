"""The leaky control chart as a stream in event time, its state kept by Spark's state store.

Days may come late and in any order within the watermark's delay. A day waits in its
site's state until the watermark has passed its end; a timer then folds the days that
are due, one after the other. So the chart is that of the ordered days whatever way the
micro-batches were cut, and a query that starts again from its checkpoint goes on where
the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.series import control_step

OUTPUT = "site long, day date, ewma double, cusum double, score double"
DAY_MS = 86_400_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chart(StatefulProcessor):
    """State of a site: the chart after its last folded day, and the days that wait."""

    def __init__(self, mean: float, scale: float, alpha: float, leak: float, slack: float):
        self.step = (mean, scale, alpha, leak, slack)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chart = handle.getValueState("chart", "ewma double, cusum double, day int")
        self.waiting = handle.getMapState("waiting", "day int", "value double, missing boolean")
        self.next_timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        folded = self.chart.get()[2] if self.chart.exists() else None
        for row in rows:  # one at a time: a key's micro-batch is never gathered
            if row["day"] is None or key[0] is None:
                continue  # a heartbeat, which only moves the watermark
            day = row["day"].toordinal()
            if (folded is not None and day <= folded) or self.waiting.containsKey((day,)):
                raise ValueError(f"site {key[0]}: {row['day']} comes again")
            missing = row["value"] is None or row["value"] != row["value"]
            self.waiting.updateValue((day,), (0.0 if missing else row["value"], missing))
        self._arm()
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Fold the days whose end the watermark has passed; a hole before one of them raises."""
        self.next_timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.waiting.keys() if _end(k[0]) <= now)
        state = dict(zip(("ewma", "cusum", "day"), self.chart.get(), strict=True)) if self.chart.exists() else None
        for day in due:
            if state is not None and day != state["day"] + 1:
                raise ValueError(f"site {key[0]}: {date.fromordinal(day)} does not follow the day before")
            value, missing = self.waiting.getValue((day,))
            self.waiting.removeKey((day,))
            new, score = control_step(state, None if missing else value, *self.step)
            state = new | {"day": day}
            yield Row(site=key[0], day=date.fromordinal(day), ewma=state["ewma"], cusum=state["cusum"], score=score)
        if due:
            self.chart.update((state["ewma"], state["cusum"], state["day"]))
        self._arm()

    def _arm(self) -> None:
        """One timer a site, at the end of its earliest waiting day."""
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is None:
            return
        at = _end(first)
        if self.next_timer.exists():
            set_for = self.next_timer.get()[0]
            if set_for <= at:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(at)
        self.next_timer.update((at,))


def _end(day: int) -> int:
    """Milliseconds since 1970 at which a day is over."""
    return int(datetime.fromordinal(day + 1).replace(tzinfo=UTC).timestamp()) * 1000


def stream_control_chart(slots: DataFrame, mean: float, scale: float, alpha: float = 0.3, leak: float = 0.9, slack: float = 0.5, delay: str = "20 days") -> DataFrame:
    """Scores of a streaming DataFrame of daily slots (site, day, value or null), in event time.

    Every day must come, missing ones as nulls, at most `delay` behind the latest day of any
    site. A day that comes later is dropped by Spark, and the hole it leaves raises, as does
    a day that comes again. A row without a site is a heartbeat that moves the watermark.
    """
    timed = slots.select("site", "day", F.col("value").cast("double").alias("value"), F.col("day").cast("timestamp").alias("at")).withWatermark("at", delay)
    return timed.groupBy("site").transformWithState(Chart(mean, scale, alpha, leak, slack), OUTPUT, "append", "eventTime")


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """State with several variables and timers needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def run_available(spark: SparkSession, chart: DataFrame, out: str, state: str) -> None:
    """Process what the stream's source has now into Parquet files, from and to the checkpoint `state`."""
    with rocks_store(spark):
        query = chart.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
