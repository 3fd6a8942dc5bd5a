"""A band that follows level, trend and season of a metric.

Additive exponential smoothing: a period is expected at ``level + trend + season[slot]``, and breaches when it is
more than two deviations off. The first season is collected, the second one teaches the deviation, then
periods are judged. A period that breaches moves the memory by the width of the band only, so an outage does
not become the new normal. Periods without data neither breach nor teach.

``step`` is the only arithmetic; the batch and the stream both run it period by period.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: How fast level, trend, season and squared deviation follow.
LEVEL, TREND, SEASON, SPREAD = 0.05, 0.002, 0.2, 0.05
#: Width of the band in deviations.
DEVIATIONS = 2.0


def step(memory: list[float], value: float | None, slot: int, slots: int) -> tuple[bool, list[float]]:
    """Judges one period: whether it breaches, and the memory after it.

    The memory is the number of periods, level, trend, squared deviation, and one number per slot
    of the season (NaN until it is known); it starts empty.
    """
    periods, level, trend, spread, *season = memory or [0.0, math.nan, 0.0, 0.0, *[math.nan] * slots]
    periods += 1
    breach = False
    if periods <= slots:
        if value is not None:
            season[slot] = value
        known = [s for s in season if not math.isnan(s)]
        if periods == slots and known:
            level = sum(known) / len(known)
            season = [s - level for s in season]
    elif value is not None and math.isnan(level):
        level, season[slot] = value, 0.0
    elif value is not None and math.isnan(season[slot]):
        season[slot] = value - level
    elif value is not None:
        expected = level + trend + season[slot]
        off = value - expected
        width = DEVIATIONS * math.sqrt(spread) + 1e-9 * (1 + abs(expected))
        if periods > 2 * slots and abs(off) > width:
            breach = True
            off = math.copysign(width, off)
        level, trend = level + trend + LEVEL * off, trend + TREND * off
        season[slot] += SEASON * off
        spread += max(SPREAD, 1 / (periods - slots)) * (off * off - spread)
    return breach, [periods, level, trend, spread, *season]


def with_breach(grid: DataFrame, period_s: int, season_s: int) -> DataFrame:
    """Adds ``breach`` to the full grid of periods (endpoint, start, value) of a batch.

    The periods of an endpoint are read in order by one task, as a stream; there is one row per
    period, however many requests.
    """
    slots = season_s // period_s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = object(), []
        for b in batches:
            out = []
            for endpoint, seconds, value in zip(*(b.column(i).to_pylist() for i in (0, 3, 2))):
                if endpoint != now:
                    now, memory = endpoint, []
                breach, memory = step(memory, value, seconds // period_s % slots, slots)
                out.append(breach)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array(out, pa.bool_())],
                ["endpoint", "start", "value", "breach"])

    rows = grid.selectExpr("endpoint", "start", "CAST(value AS DOUBLE) AS value",
                           "unix_seconds(start) AS seconds")
    return rows.repartition("endpoint").sortWithinPartitions("endpoint", "start").mapInArrow(
        run, "endpoint string, start timestamp, value double, breach boolean")
