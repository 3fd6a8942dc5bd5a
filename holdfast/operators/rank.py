"""Ranking, top-k and threshold curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.ordering import running_sums, score_splits, with_score_bucket
from holdfast.operators.profile import q


def top_importance(df: DataFrame, k: int = 10, value: str = "importance",
                   name: str = "feature") -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(name)).limit(k)


def top_factors(contrib: DataFrame, k: int = 5, row: str = "row_id", value: str = "contribution",
                name: str = "feature", zero_is_negative: bool = False) -> DataFrame:
    """The ``k`` largest contributions of either sign per row.

    A row has one entry per feature, so the window holds a handful of rows. Zeros are left out,
    or counted as negative with ``zero_is_negative``.
    """
    v = F.col(value)
    signed = contrib.withColumn(
        "direction", F.when(v > 0, "positive").when(v < 0, "negative").otherwise(
            F.lit("negative") if zero_is_negative else F.lit(None)
        )
    ).filter(F.col("direction").isNotNull())
    w = Window.partitionBy(row, "direction").orderBy(F.abs(v).desc(), F.col(name))
    return signed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def leaderboard(df: DataFrame, metric: str, name: str = "model", order: str | None = None):
    """Models by falling metric; ties keep input order when ``order`` names it."""
    return df.orderBy(F.desc(metric), F.asc(order or name))


def best_by(df: DataFrame, metric: str, name: str = "model", order: str | None = None):
    """Name and metric of the best row; the first in ``order`` wins ties."""
    return leaderboard(df, metric, name, order).limit(1).select(name, metric)


def metric_range(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.min(metric).alias("low"), F.max(metric).alias("high"))


def threshold_counts(
    scored: DataFrame, label: str = "label", p: str = "p", prediction: str | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Per distinct score: positives, negatives, and both summed from the highest score down."""
    splits = score_splits(scored, p) if splits is None else splits
    y = q(label)
    aggs = [F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg")]
    if prediction:
        guess = q(prediction).cast("int")
        aggs += [
            F.sum(y * guess).cast("long").alias("tp_at"),
            F.sum((1 - y) * guess).cast("long").alias("fp_at"),
        ]
    per_score = scored.groupBy(q(p).cast("double").alias("threshold")).agg(*aggs)
    bucketed = with_score_bucket(per_score, "threshold", splits)
    return running_sums(
        bucketed, {"tp": F.col("pos"), "fp": F.col("neg")}, "_bucket",
        [F.col("threshold").desc()], descending=True,
    ).drop("_bucket")


def _totals(scored: DataFrame, label: str) -> tuple:
    y = q(label)
    one = scored.agg(
        F.struct(F.sum(y).cast("long").alias("p"), F.sum(1 - y).cast("long").alias("n")).alias("t")
    ).scalar()
    return one["p"], one["n"]


def roc_points(scored: DataFrame, label: str = "label", p: str = "p",
               splits: Sequence[float] | None = None) -> DataFrame:
    """False and true positive rate per distinct score, with the (0, 0) start point."""
    pos, neg = _totals(scored, label)
    points = threshold_counts(scored, label, p, splits=splits).select(
        "threshold",
        F.round(F.try_divide(F.col("fp"), neg), 6).alias("fpr"),
        F.round(F.try_divide(F.col("tp"), pos), 6).alias("tpr"),
    )
    start = points.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return points.unionByName(start)


def pr_points(scored: DataFrame, label: str = "label", p: str = "p",
              splits: Sequence[float] | None = None) -> DataFrame:
    """Precision and recall per distinct score, with the (recall 0, precision 1) end point."""
    pos, _ = _totals(scored, label)
    points = threshold_counts(scored, label, p, splits=splits).select(
        "threshold",
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide(F.col("tp"), pos), 6).alias("recall"),
    )
    end = points.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return points.unionByName(end)


def recent_jobs(jobs: DataFrame, now: str, days: int, limit: int | None = None,
                created: str = "created", name: str = "job") -> DataFrame:
    """Jobs created in the look-back period, newest first."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = jobs.filter(F.col(created) > since).orderBy(F.desc(created), F.asc(name))
    return recent.limit(limit) if limit else recent


def top_pairs(pairs: DataFrame, n: int = 5, a: str = "feature_1", b: str = "feature_2",
              strength: str = "interaction_strength") -> DataFrame:
    """Strongest pairs above the diagonal of a long matrix."""
    return pairs.filter(F.col(a) < F.col(b)).orderBy(F.desc(strength), a, b).limit(n)


def take_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(q(order)).limit(n)
