"""Windowed endpoint metrics. The same functions take batch and streaming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordering import running_sums, score_splits, with_score_bucket
from holdfast.session import staged

WATERMARK = "10 minutes"

STATS = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max}


def _windowed(df: DataFrame, period_s: int, aggs: Sequence[Column], watermark: str) -> DataFrame:
    span = F.window("ts", f"{period_s} seconds")
    return df.withWatermark("ts", watermark).groupBy(span, "endpoint", "metric").agg(*aggs)


def _flat(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.select(
        "endpoint", "metric", F.col("window.start").alias("start"),
        F.col("window.end").alias("end"), *values,
    )


def window_metric(df: DataFrame, period_s: int = 60, stat: str = "sum",
                  watermark: str = WATERMARK) -> DataFrame:
    """Tumbling sum, average, count or maximum per endpoint and metric."""
    agg = STATS[stat]("value").alias("value")
    return _flat(_windowed(df, period_s, [agg], watermark), ["value"])


def window_percentiles(df: DataFrame, metric: str = "ModelLatency", period_s: int = 60,
                       probs: Sequence[float] = (0.5, 0.9, 0.99),
                       watermark: str = WATERMARK, approx: bool | None = None) -> DataFrame:
    """Percentiles per window: exact on batch frames, approximate (nearest rank) on streams."""
    approx = df.isStreaming if approx is None else approx
    rows = df.filter(F.col("metric") == metric)
    names = [f"p{round(p * 100)}" for p in probs]
    if not approx:
        return _exact_percentiles(rows, period_s, dict(zip(names, probs)))
    aggs = [percentile_of("value", p).alias(n) for n, p in zip(names, probs)]
    return _flat(_windowed(rows, period_s, aggs, watermark), names)


def _exact_percentiles(rows: DataFrame, period_s: int, probs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per window, from counted values and running sums over buckets.

    No window's values meet in one buffer: equal values are counted before the shuffle, and counts
    are summed up inside ordered buckets of the values.
    """
    keys = ["start", "end", "endpoint", "metric"]
    span = F.window("ts", f"{period_s} seconds")
    counts = rows.filter(F.col("value").isNotNull()).groupBy(
        span.alias("w"), "endpoint", "metric", F.col("value").cast("double").alias("v")
    ).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "endpoint", "metric", "v", "n"
    )
    counts = staged(counts, "window-values")
    ranked = running_sums(
        with_score_bucket(counts, "v", score_splits(counts, "v")), {"upto": F.col("n")},
        "_bucket", [F.col("v")], within=keys,
    )
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = ranked.join(total, keys)
    out = []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)

        def value(at):
            return F.min(F.when((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at),
                                F.col("v")))

        a, b = value(low), value(high)
        share = F.max(spot - low)
        out.append(F.when((share == 0) | (a == b), a).otherwise((1 - share) * a + share * b)
                   .alias(name))
    return placed.groupBy(*keys).agg(*out).select("endpoint", "metric", "start", "end", *probs)


def percentile_of(col: str, p: float) -> Column:
    """Nearest-rank percentile from a sketch, as streams use it."""
    return F.percentile_approx(col, p, 10_000)


def alarm_windows(df: DataFrame, spec, watermark: str = WATERMARK,
                  approx: bool | None = None) -> DataFrame:
    """The windowed statistic an alarm looks at."""
    rows = df.filter(F.col("metric") == spec.metric)
    if spec.stat.startswith("p"):
        p = int(spec.stat[1:]) / 100
        out = window_percentiles(rows, spec.metric, spec.period_s, [p], watermark, approx)
        return out.withColumnRenamed(spec.stat, "value")
    return window_metric(rows, spec.period_s, spec.stat, watermark)
