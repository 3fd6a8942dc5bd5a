import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast.streaming import percentiles as pc

T0 = dt.datetime(2024, 1, 1)


def metrics(spark, seed=1):
    rng = random.Random(seed)
    values = [lambda: rng.lognormvariate(3, 2), lambda: -rng.random() * 50, lambda: 0.0,
              lambda: rng.choice([1e-12, 1e15, 7.0])]
    rows = [(T0 + dt.timedelta(seconds=rng.randint(0, 1499)), f"e{rng.randint(0, 1)}", "ModelLatency",
             rng.choice(values)()) for _ in range(3000)]
    rows += [(T0, "e0", "ModelLatency", None), (T0, "e0", "ModelLatency", float("nan"))]
    return rows, spark.createDataFrame(rows, "ts timestamp, endpoint string, metric string, value double")


def exact(rows, period):
    groups = {}
    for ts, e, _, v in rows:
        if v is not None and not math.isnan(v):
            at = T0 + dt.timedelta(seconds=(ts - T0).total_seconds() // period * period)
            groups.setdefault((e, at), []).append(v)
    return {k: {p: sorted(v)[max(0, math.ceil(len(v) * p) - 1)] for p in (0.5, 0.9, 0.99)} | {
        "n": len(v)} for k, v in groups.items()}


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_five_short_states_make_a_long_one(spark, error):
    rows, frame = metrics(spark)
    short = pc.percentile_cells(frame, 60, error)
    merged = pc.states(pc.merged_cells(short, 300))
    whole = pc.states(pc.percentile_cells(frame, 300, error))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    want = exact(rows, 300)
    got = pc.read_states(merged, error=error).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["endpoint"], r["start"]]
        assert r["n"] == w["n"]
        for p in (0.5, 0.9, 0.99):
            assert abs(r[f"p{round(p * 100)}"] - w[p]) <= error * abs(w[p]) * (1 + 1e-9)


def test_cells_keep_the_order_of_values(spark):
    values = sorted([-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.1, 0.2, 3.0, 1e300])
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", pc.cell_of(F.col("v")).alias("c")).select(
        "v", "c", pc.middle_of(F.col("c")).alias("m")).collect()
    cells = [r["c"] for r in rows]
    assert cells == sorted(cells)
    assert all(abs(r["m"] - r["v"]) <= pc.ERROR * abs(r["v"]) * (1 + 1e-9) for r in rows)


def test_no_rows(spark):
    _, frame = metrics(spark)
    assert pc.read_states(pc.states(pc.percentile_cells(frame.where("false")))).collect() == []
