import datetime as dt

from holdfast.operators import cost
from holdfast.sources.tables import price_table

NOW = "2024-01-10 00:00:00"


def endpoints(spark):
    t = dt.datetime(2024, 1, 8)
    eps = spark.createDataFrame([
        ("a", "InService", t, "c1"), ("b", "InService", None, "c2"), ("c", "Creating", t, "c1"),
        ("d", "InService", t, "c3"),
    ], "name string, status string, created_at timestamp, config string")
    cfg = spark.createDataFrame([
        ("c1", [("ml.m5.xlarge", 2), ("nowhere", 1)]), ("c2", [(None, None)]), ("c3", []),
    ], "config string, variants array<struct<instance_type: string, instance_count: int>>")
    return cost.endpoint_costs(eps, cfg, price_table(spark), NOW)


def test_endpoint_costs(spark):
    got = {r["endpoint_name"]: r for r in endpoints(spark).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"]["hourly_cost_usd"] == 0.56 and got["a"]["runtime_hours"] == 48.0
    assert got["a"]["total_cost_usd"] == 26.88 and got["a"]["instance_type"] == "ml.m5.xlarge"
    assert got["b"]["hourly_cost_usd"] == 0.056 and got["b"]["runtime_hours"] == 0.0
    assert got["d"]["instance_type"] == "unknown" and got["d"]["hourly_cost_usd"] == 0.0


def test_job_without_end_costs_nothing(spark):
    t = dt.datetime(2024, 1, 8)
    jobs = spark.createDataFrame([
        ("x", "Completed", "ml.m5.large", 2, t, t, t + dt.timedelta(hours=3)),
        ("y", "InProgress", "odd", 1, t, t, None),
    ], "job string, status string, instance_type string, instance_count int, created timestamp, "
       "started timestamp, ended timestamp")
    got = {r["job"]: r for r in cost.job_costs(jobs, price_table(spark)).collect()}
    assert got["x"]["total_cost_usd"] == 0.69 and got["x"]["duration_minutes"] == 180.0
    assert got["y"]["total_cost_usd"] == 0.0 and got["y"]["hourly_rate_usd"] == 0.115


def test_recommendations(spark):
    recs = cost.cost_recommendations(endpoints(spark)).collect()
    kinds = sorted((r["type"], r["resource"]) for r in recs)
    assert kinds == [("best_practice", "all"), ("best_practice", "all"), ("optimization", "a"),
                     ("warning", "a"), ("warning", "d")]


def test_idle(spark):
    assert cost.idle_endpoints(endpoints(spark), 24).count() == 2


def test_report_without_savings(spark):
    summary = cost.cost_summary(endpoints(spark), spark.createDataFrame(
        [], "job string, total_cost_usd double, created timestamp"), NOW)
    recs = cost.cost_recommendations(endpoints(spark)).filter("type = 'best_practice'")
    lines = [r["text"] for r in cost.cost_report(summary, recs).orderBy("line").collect()]
    assert len(lines) == 16 and "savings" not in " ".join(lines)
    assert "Training Jobs: 0" in lines
