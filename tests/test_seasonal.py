import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.streaming import alarms as al, seasonal, windows as wi

T0 = dt.datetime(2024, 1, 1)
HOUR = al.SEASONAL_ANOMALY.every(3600)


def daily(hours, rng, drop=(), growth=0.0):
    """Requests by hour: a daily cycle, a slow growth, even noise, and hours with a planted drop."""
    return [20.0 if h in drop else 200 + growth * h + 120 * math.sin(h / 24 * 2 * math.pi)
            + rng.uniform(-10, 10) for h in range(hours)]


def breaches(values, slots=24):
    memory, out = [], []
    for h, v in enumerate(values):
        breach, memory = seasonal.step(memory, v, h % slots, slots)
        out.append(breach)
    return out


@pytest.mark.parametrize("growth", [0.0, 0.05])
def test_a_daily_cycle_is_normal_and_a_drop_is_not(growth):
    for seed in range(10):
        rng = random.Random(seed)
        quiet = breaches(daily(24 * 20, rng, growth=growth))
        assert sum(quiet) < 0.05 * len(quiet) and not any(   # two deviations
            all(quiet[i:i + 3]) for i in range(len(quiet)))
        drop = range(24 * 12 + 5, 24 * 12 + 11)
        found = breaches(daily(24 * 20, rng, drop, growth))
        assert all(found[h] for h in drop)
        later = found[24 * 13:]
        assert not any(all(later[i:i + 3]) for i in range(len(later)))


def test_gaps_and_first_seasons():
    assert breaches([None] * 100) == [False] * 100
    rng = random.Random(3)
    values = [v if h % 7 else None for h, v in enumerate(daily(24 * 10, rng))]
    assert sum(breaches(values)) < 0.05 * len(values)
    assert not any(breaches([1.0, 500.0] * 24))   # two seasons only teach
    assert breaches([5.0] * 80 + [6.0])[-1]       # no spread at all


def test_batch_alarm(spark):
    rng = random.Random(1)
    drop = range(24 * 8 + 3, 24 * 8 + 9)
    rows = [(T0 + dt.timedelta(hours=h), e, "Invocations", v)
            for e, hours in (("quiet", ()), ("drops", drop))
            for h, v in enumerate(daily(24 * 12, rng, hours))]
    frame = spark.createDataFrame(rows, "ts timestamp, endpoint string, metric string, value double")
    got = al.alarm_batch(frame, HOUR).orderBy("at").collect()
    assert [(r["endpoint"], r["state"]) for r in got] == [("drops", "ALARM"), ("drops", "OK")]
    assert got[0]["at"] == T0 + dt.timedelta(hours=24 * 8 + 3 + 3)
    grid = al.period_grid(wi.alarm_windows(frame, HOUR), 3600)
    judged = seasonal.with_breach(grid, 3600, 86_400)
    assert judged.count() == 2 * 24 * 12 and judged.where(F.col("breach")).count() >= 6
    assert al.alarm_batch(frame.where("false"), HOUR).count() == 0
