"""Alarms over windowed metrics.

An alarm goes off when its statistic breaches the threshold in a number of consecutive periods,
and goes back with the first period that does not. Periods without data breach or not, as the
alarm says. ``alarm_batch`` computes the transitions over a full grid of periods; ``alarm_stream``
keeps, per endpoint, the next period it expects, the length of the running breach and the state.
Windows are aggregated before they reach the state, so an endpoint with very many requests still
sends one row per period.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from holdfast.session import staged
from holdfast.streaming import seasonal
from holdfast.streaming.windows import STATS, WATERMARK, alarm_windows, percentile_of

OK, ALARM = "OK", "ALARM"
HISTORY = 12           # periods of the trailing band
DEVIATIONS = 2.0


@dataclass(frozen=True)
class AlarmSpec:
    """What breaches, for how long, and what silence means."""

    name: str
    metric: str
    stat: str
    period_s: int
    threshold: float
    periods: int
    above: bool = True              # breach above the threshold, or at and below it
    missing_breaches: bool = False
    band: bool = False              # breach outside the trailing band, threshold unused
    season_s: int = 0               # breach outside the seasonal band, threshold unused

    def every(self, seconds: int) -> AlarmSpec:
        return replace(self, period_s=seconds)


# The declared alarms.
HIGH_5XX = AlarmSpec("high-5xx-errors", "Invocation5XXErrors", "sum", 60, 1.0, 5)
HIGH_LATENCY = AlarmSpec("high-latency", "ModelLatency", "p99", 60, 2_000_000.0, 3)
NO_INVOCATIONS = AlarmSpec("no-invocations", "Invocations", "sum", 300, 0.0, 12, above=False,
                           missing_breaches=True)
HIGH_CPU = AlarmSpec("high-cpu", "CPUUtilization", "avg", 300, 80.0, 3)
HIGH_MEMORY = AlarmSpec("high-memory", "MemoryUtilization", "avg", 300, 85.0, 3)
HIGH_DISK = AlarmSpec("high-disk", "DiskUtilization", "avg", 300, 80.0, 3)
VOLUME_ANOMALY = AlarmSpec("invocation-anomaly", "Invocations", "sum", 300, 0.0, 3, band=True)
SEASONAL_ANOMALY = replace(VOLUME_ANOMALY, name="seasonal-anomaly", band=False, season_s=86_400)
COMPOSITE = (HIGH_5XX, HIGH_LATENCY, NO_INVOCATIONS, HIGH_MEMORY)


def _breach(value: Column, spec: AlarmSpec) -> Column:
    hit = value > spec.threshold if spec.above else value <= spec.threshold
    return F.coalesce(hit, F.lit(spec.missing_breaches))


def period_grid(windows: DataFrame, period_s: int) -> DataFrame:
    """Every period of every endpoint, from its first window to the last window of all.

    The grid grows with the length of time, not with the number of requests.
    """
    ends = windows.groupBy("endpoint").agg(F.min("start").alias("first"))
    last = windows.agg(F.max("start")).scalar()
    step = F.expr(f"INTERVAL {period_s} SECONDS")
    grid = ends.select("endpoint", F.explode(F.sequence("first", last, step)).alias("start"))
    return grid.join(windows.select("endpoint", "start", "value"), ["endpoint", "start"], "left")


def _runs(grid: DataFrame, spec: AlarmSpec) -> DataFrame:
    """Length of the running breach and the state at every period."""
    by_time = Window.partitionBy("endpoint").orderBy("start")
    island = by_time.rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.withColumn("block", F.sum(F.when(F.col("breach"), 0).otherwise(1)).over(island))
        .withColumn("run", F.sum(F.col("breach").cast("int")).over(
            Window.partitionBy("endpoint", "block").orderBy("start")
            .rowsBetween(Window.unboundedPreceding, 0)
        ))
        .withColumn("state", F.when(F.col("run") >= spec.periods, ALARM).otherwise(OK))
    )


def _changes(states: DataFrame, spec: AlarmSpec) -> DataFrame:
    before = F.lag("state", 1, OK).over(Window.partitionBy("endpoint").orderBy("start"))
    step = F.expr(f"INTERVAL {spec.period_s} SECONDS")
    return states.withColumn("before", before).filter("state <> before").select(
        "endpoint", F.lit(spec.name).alias("alarm"), (F.col("start") + step).alias("at"), "state"
    )


def alarm_batch(df: DataFrame, spec: AlarmSpec, approx: bool = False) -> DataFrame:
    """Transitions ``(endpoint, alarm, at, state)`` from a batch of metric rows.

    ``approx`` takes nearest-rank percentiles, as streams do.
    """
    # written once: the grid asks for the first and last period and for the values
    windows = staged(alarm_windows(df, spec, approx=approx), "alarm-windows")
    grid = period_grid(windows, spec.period_s)
    if spec.season_s:
        grid = seasonal.with_breach(grid, spec.period_s, spec.season_s)
    elif spec.band:
        trail = Window.partitionBy("endpoint").orderBy("start").rowsBetween(-HISTORY, -1)
        grid = grid.withColumns({
            "n": F.count("value").over(trail), "mean": F.avg("value").over(trail),
            "dev": F.stddev_pop("value").over(trail),
        })
        outside = F.abs(F.col("value") - F.col("mean")) > DEVIATIONS * F.col("dev") + 1e-9
        grid = grid.withColumn("breach", F.coalesce((F.col("n") >= 2) & outside, F.lit(False)))
    else:
        grid = grid.withColumn("breach", _breach(F.col("value"), spec))
    return _changes(_runs(grid, spec), spec)


def composite_batch(transitions: DataFrame, name: str = "endpoint-unhealthy") -> DataFrame:
    """Transitions of the alarm that is on while any of the given alarms is on."""
    alarm_on = F.when(F.col("state") == ALARM, 1).otherwise(-1)
    moves = transitions.groupBy("endpoint", "at").agg(F.sum(alarm_on).alias("move"))
    upto = Window.partitionBy("endpoint").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    levels = moves.withColumn("on", F.sum("move").over(upto)).withColumn(
        "state", F.when(F.col("on") > 0, ALARM).otherwise(OK)
    )
    before = F.lag("state", 1, OK).over(Window.partitionBy("endpoint").orderBy("at"))
    return levels.withColumn("before", before).filter("state <> before").select(
        "endpoint", F.lit(name).alias("alarm"), "at", "state"
    )


TRANSITION = "endpoint string, alarm string, at timestamp, state string"


class _Follower(StatefulProcessor):
    """One endpoint: evaluate periods in order, fill gaps, emit changes of state.

    State is the next period, the length of the running breach, the current state, what the band
    remembers (trailing values, or level, trend and season), and windows that arrived ahead of an
    earlier one.
    """

    def __init__(self, spec: AlarmSpec):
        self.spec = spec
        self.step = spec.period_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_ms long, run int, state string")
        self.trail = handle.getValueState("trail", "known array<double>")
        self.ahead = handle.getMapState("ahead", "start_ms long", "value double")

    def _breaches(self, value, known) -> bool:
        spec = self.spec
        if value is None:
            return spec.missing_breaches
        if spec.band:
            known = [h for h in known if h is not None]
            if len(known) < 2:
                return False
            mean = sum(known) / len(known)
            dev = (sum((h - mean) ** 2 for h in known) / len(known)) ** 0.5
            return abs(value - mean) > DEVIATIONS * dev + 1e-9
        return value > spec.threshold if spec.above else value <= spec.threshold

    def _judge(self, value, known, ms: int) -> tuple[bool, list]:
        """Whether a period breaches, and what the band knows after it."""
        spec = self.spec
        if spec.season_s:
            slots = spec.season_s // spec.period_s
            return seasonal.step(known, value, ms // self.step % slots, slots)
        return self._breaches(value, known), [*known, value][-HISTORY:] if spec.band else known

    def _advance(self, key, upto_ms: int) -> Iterator[pd.DataFrame]:
        """Evaluate every period that ends at or before ``upto_ms``."""
        if not self.place.exists():
            return
        expected, length, current = self.place.get()
        known = list(self.trail.get()[0]) if self.trail.exists() else []
        out = []
        while expected + self.step <= upto_ms:
            spot = (expected,)
            value = None
            if self.ahead.containsKey(spot):
                value = self.ahead.getValue(spot)[0]
                self.ahead.removeKey(spot)
            breach, known = self._judge(value, known, expected)
            length = length + 1 if breach else 0
            now = ALARM if length >= self.spec.periods else OK
            if now != current:
                at = pd.Timestamp(expected + self.step, unit="ms")
                out.append((key[0], self.spec.name, at, now))
                current = now
            expected += self.step
        self.place.update((expected, length, current))
        if known:
            self.trail.update((known,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(expected + self.step)
        if out:
            yield pd.DataFrame(out, columns=["endpoint", "alarm", "at", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for start, value in zip(batch["start"], batch["value"]):
                ms = int(start.timestamp() * 1000)
                self.ahead.updateValue((ms,), (None if pd.isna(value) else float(value),))
                first = ms if first is None else min(first, ms)
        if first is not None and not self.place.exists():
            self.place.update((first, 0, OK))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def alarm_stream(df: DataFrame, spec: AlarmSpec, watermark: str = WATERMARK) -> DataFrame:
    """Transitions of an alarm on a streaming frame of metric rows.

    Needs the RocksDB state store, see ``STATE_CONF`` of this package. The timer of an endpoint fires
    when the watermark passes a period without data, so silence is noticed as well.
    """
    rows = df.filter(F.col("metric") == spec.metric)
    span = F.window("ts", f"{spec.period_s} seconds")
    if spec.stat.startswith("p"):
        value = percentile_of("value", int(spec.stat[1:]) / 100)
    else:
        value = STATS[spec.stat]("value")
    windows = (
        rows.withWatermark("ts", watermark).groupBy(span, "endpoint").agg(value.alias("value"))
        .select("endpoint", F.col("window.start").alias("start"), "value")
    )
    return windows.groupBy("endpoint").transformWithStateInPandas(
        statefulProcessor=_Follower(spec), outputStructType=TRANSITION, outputMode="append",
        timeMode="eventTime",
    )


class _AnyAlarm(StatefulProcessor):
    """One endpoint: how many alarms are on, moved in time order once the watermark allows."""

    def __init__(self, name: str):
        self.name = name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.on = handle.getValueState("on", "n int")
        self.moves = handle.getMapState("moves", "at_ms long", "move int")

    def _advance(self, key, upto_ms: int) -> Iterator[pd.DataFrame]:
        n = self.on.get()[0] if self.on.exists() else 0
        pending = sorted((k[0], v[0]) for k, v in self.moves.iterator())
        out = []
        for at, move in pending:
            if at > upto_ms:
                break
            before, n = n, n + move
            if (before > 0) != (n > 0):
                out.append((key[0], self.name, pd.Timestamp(at, unit="ms"), ALARM if n else OK))
            self.moves.removeKey((at,))
        self.on.update((n,))
        later = [at for at, _ in pending if at > upto_ms]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if later:
            self.handle.registerTimer(min(later))
        if out:
            yield pd.DataFrame(out, columns=["endpoint", "alarm", "at", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, state in zip(batch["at"], batch["state"]):
                spot = (int(at.timestamp() * 1000),)
                move = 1 if state == ALARM else -1
                if self.moves.containsKey(spot):
                    move += self.moves.getValue(spot)[0]
                self.moves.updateValue(spot, (move,))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def composite_stream(transitions: DataFrame, name: str = "endpoint-unhealthy",
                     watermark: str = "1 hour") -> DataFrame:
    """Composite alarm over a stream of transitions, such as the table the alarms write.

    The watermark has to cover the longest period, because alarms report at different times.
    """
    return transitions.withWatermark("at", watermark).groupBy("endpoint").transformWithStateInPandas(
        statefulProcessor=_AnyAlarm(name), outputStructType=TRANSITION, outputMode="append",
        timeMode="eventTime",
    )
