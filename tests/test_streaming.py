import datetime as dt

import pytest
from pyspark.sql import functions as F

from holdfast.operators.rules import churn_rules
from holdfast.plans.train import Hybrid
from holdfast.sources.tables import closed_form_score
from holdfast.streaming import alarms as al, capture as cp, windows as wi
from holdfast.streaming.run import drained
from conftest import customers

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, endpoint string, metric string, value double"


def rows(minutes, metric, value=1.0, endpoint="e"):
    return [(START + dt.timedelta(minutes=m), endpoint, metric, float(value)) for m in minutes]


def files(spark, path, batches):
    """One file per batch, in order of arrival."""
    import time

    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)                 # the file source orders files by whole seconds
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path)),
        spark.read.schema(SCHEMA).parquet(str(path)),
    )


def table(df):
    return sorted(tuple(r) for r in df.collect())


def at(minute):
    return START + dt.timedelta(minutes=minute)


def test_consecutive_breaches(spark):
    spec = al.AlarmSpec("x", "m", "sum", 60, 1.0, 3)
    data = rows([0, 1, 2, 3, 4, 5], "m", 2) + rows([7, 8, 9], "m", 2) + rows([10], "m", 1)
    got = al.alarm_batch(spark.createDataFrame(data, SCHEMA), spec)
    # minute 6 has no data, which is no breach
    assert table(got) == [
        ("e", "x", at(3), "ALARM"), ("e", "x", at(7), "OK"),
        ("e", "x", at(10), "ALARM"), ("e", "x", at(11), "OK"),
    ]


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    spec = al.AlarmSpec("x", "m", "avg", 60, 5.0, 2)
    minutes = [m for m in range(120) if m % 7 != 6]
    data = [r for m in minutes for e in ("a", "b")
            for r in rows([m], "m", (m * (3 if e == "a" else 5)) % 11, e)]
    live, still = files(spark, tmp_path / "in", [data[:80], data[80:150], data[150:]])
    got = drained(al.alarm_stream(live, spec, "5 minutes"), "alarm")
    closed = at(119) - dt.timedelta(minutes=5)
    wanted = [r for r in table(al.alarm_batch(still, spec)) if r[2] <= closed]
    assert table(got) == wanted and len(wanted) > 10


def test_silence_goes_off_in_the_stream(spark, tmp_path):
    spec = al.NO_INVOCATIONS.every(60)
    quiet = rows(range(0, 5), "Invocations", endpoint="quiet")
    busy = rows(range(0, 60), "Invocations", endpoint="busy")
    live, still = files(spark, tmp_path / "in", [quiet + busy[:20], busy[20:]])
    got = table(drained(al.alarm_stream(live, spec, "1 minute"), "silence"))
    assert got == [("quiet", "no-invocations", at(17), "ALARM")]
    assert table(al.alarm_batch(still, spec)) == got


def test_late_rows_are_dropped(spark, tmp_path):
    live, still = files(spark, tmp_path / "in", [
        rows([0, 30], "m"), rows([31], "m"), rows([1], "m", 100) + rows([60], "m"),
        rows([90], "m"),
    ])
    got = drained(wi.window_metric(live, 60, "sum", "5 minutes"), "late")
    assert 100.0 not in [r["value"] for r in got.collect()]
    assert 100.0 in [r["value"] for r in wi.window_metric(still, 60, "sum").collect()]


def test_composite_stream_equals_batch(spark, tmp_path):
    moves = [
        ("e", "a", at(1), "ALARM"), ("e", "b", at(2), "ALARM"), ("e", "a", at(3), "OK"),
        ("e", "b", at(5), "OK"), ("e", "a", at(9), "ALARM"), ("e", "a", at(30), "OK"),
        ("e", "b", at(30), "ALARM"), ("f", "a", at(200), "ALARM"),
    ]
    path = str(tmp_path / "t")
    spark.createDataFrame(moves, al.TRANSITION).write.parquet(path)
    live = spark.readStream.schema(al.TRANSITION).parquet(path)
    got = table(drained(al.composite_stream(live, watermark="10 minutes"), "composite"))
    assert [(r[2], r[3]) for r in got] == [(at(1), "ALARM"), (at(5), "OK"), (at(9), "ALARM")]
    batch = table(al.composite_batch(spark.read.parquet(path)))
    assert [r for r in batch if r[0] == "e"] == got


def test_band_needs_history(spark):
    spec = al.VOLUME_ANOMALY.every(60)
    steady = [r for m in range(20) for r in rows([m] * 4, "Invocations")]
    burst = [r for m in range(20, 24) for r in rows([m] * 40 * (m - 18), "Invocations")]
    got = table(al.alarm_batch(spark.createDataFrame(steady + burst, SCHEMA), spec))
    assert got and got[0][2] >= at(22) and got[0][3] == "ALARM"


def test_captured_share(spark):
    df = spark.range(5000).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    n = cp.capture(df, 20, "id").count()
    assert 800 < n < 1200
    assert cp.capture(df, 100, "id").count() == 5000 and cp.capture(df, 0, "id").count() == 0


def test_scoring_a_stream(spark, tmp_path):
    df = spark.createDataFrame(customers(50))
    df.write.parquet(str(tmp_path / "c"))

    class ClosedForm:
        def score(self, x):
            p = closed_form_score()
            return x.withColumns({"p": p, "prediction": (p > 0.5).cast("int")})

    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "c"))
    hybrid = Hybrid(churn_rules(), ClosedForm())
    now = "2024-01-01 00:00:00"
    got = table(drained(cp.score_stream(live, hybrid, now), "scores"))
    assert got == table(cp.score_batch(df, hybrid, now)) and len(got) == 50


@pytest.mark.parametrize("stat, value", [("sum", 6.0), ("avg", 2.0), ("max", 3.0), ("count", 3)])
def test_window_statistics(spark, stat, value):
    data = rows([0], "m", 1) + rows([0.2], "m", 2) + rows([0.4], "m", 3)
    got = wi.window_metric(spark.createDataFrame(data, SCHEMA), 60, stat).first()
    assert got["value"] == value and got["start"] == START
