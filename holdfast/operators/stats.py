"""Aggregations and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.features import cut
from holdfast.operators.profile import is_missing, long_rows, q
from holdfast.operators.quantiles import quantiles


def _rate(target: str):
    return [F.round(F.avg(q(target)), 6).alias("rate"), F.count(q(target)).alias("count")]


def rate_by(df: DataFrame, col: str, target: str) -> DataFrame:
    """Class rate and labelled rows per value; missing keys are left out."""
    return df.filter(~is_missing(df, col)).groupBy(q(col).alias("value")).agg(*_rate(target))


def rate_by_value(df: DataFrame, col: str, target: str) -> DataFrame:
    return rate_by(df, col, target).orderBy("value")


def rate_by_many(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """``rate_by`` for several columns from one scan."""
    sets = [[q(c)] for c in cols]
    grouped = df.groupingSets(sets, *[q(c) for c in cols]).agg(
        F.grouping_id().alias("gid"), *_rate(target)
    )
    last = len(cols) - 1
    # the grouping id has a zero bit for the one column that is grouped by
    mask = {c: sum(1 << (last - j) for j in range(len(cols)) if j != i)
            for i, c in enumerate(cols)}
    column = reduce(
        lambda acc, c: acc.when(F.col("gid") == mask[c], F.lit(c)),
        cols[1:], F.when(F.col("gid") == mask[cols[0]], F.lit(cols[0])),
    )
    return (
        grouped.select(
            column.alias("column"),
            F.coalesce(*[q(c).cast("string") for c in cols]).alias("value"),
            "rate", "count",
        ).filter(F.col("value").isNotNull())
    )


def crosstab_pct(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """Share of each value of ``b`` in every row of ``a``, in percent."""
    grouped = df.filter(~is_missing(df, a) & ~is_missing(df, b)).groupBy(q(a).alias("value"))
    counts = grouped.agg(
        F.count("*").alias("n"), *[F.count_if(q(b) == F.lit(v)).alias(f"n{i}")
                                   for i, v in enumerate(values)]
    )
    return counts.select(
        "value",
        *[F.round(F.col(f"n{i}") * 100.0 / F.col("n"), 6).alias(f"pct_{v}")
          for i, v in enumerate(values)],
    )


def rate_by_bin(df: DataFrame, col: str, edges: Sequence, target: str) -> DataFrame:
    return rate_by(df.withColumn("_bin", cut(col, edges)), "_bin", target)


def qcut_edges(df: DataFrame, col: str, n: int) -> list[float]:
    """Edges of ``n`` quantile bins; equal edges are an error."""
    edges = quantiles(df, {col: q(col)}, [i / n for i in range(n + 1)])[col]
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges of {col} must be unique: {edges}")
    return edges


def qcut(df: DataFrame, col: str, n: int, labels: Sequence | None = None, out: str = "qbin"):
    """Add the quantile bin of ``col``; right-closed, lowest value included."""
    return df.withColumn(out, cut(col, qcut_edges(df, col, n), labels))


def rate_by_qbin(df: DataFrame, col: str, n: int, target: str, labels=None) -> DataFrame:
    return rate_by(qcut(df, col, n, labels, "_bin"), "_bin", target)


def target_corr(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target, highest first."""
    agg = df.agg(*[F.corr(q(c).cast("double"), q(target).cast("double")).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    rows = [(F.lit(c), F.round(F.col(f"r{i}"), 6)) for i, c in enumerate(cols)]
    return long_rows(agg, rows, ["feature", "corr"]).orderBy(F.desc("corr"), "feature")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise correlations of a fixed column list, from one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    agg = df.agg(*[
        F.corr(q(cols[i]).cast("double"), q(cols[j]).cast("double")).alias(f"r{i}_{j}")
        for i, j in pairs
    ])
    rows = [
        (F.lit(a), F.lit(b), F.round(F.col(f"r{min(i, j)}_{max(i, j)}"), 6))
        for i, a in enumerate(cols) for j, b in enumerate(cols)
    ]
    return long_rows(agg, rows, ["feature_a", "feature_b", "corr"])


def dup_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def dup_keys(df: DataFrame, key: str) -> DataFrame:
    groups = df.groupBy(q(key)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(q(col).alias("value")).filter(F.col("value").isNotNull()).distinct()


def subset_report(df: DataFrame, in_subset, target: str) -> DataFrame:
    """Size, class rate and share of a subset, next to the whole table."""
    hit = F.coalesce(in_subset, F.lit(False))
    return df.agg(
        F.count("*").alias("total_rows"),
        F.round(F.avg(q(target)), 4).alias("total_rate"),
        F.count_if(hit).alias("rows"),
        F.round(F.avg(F.when(hit, q(target))), 4).alias("rate"),
        F.round(F.try_divide(F.count_if(hit) * 100.0, F.count("*")), 1).alias("pct_of_total"),
    )


def cv_summary(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Mean, population deviation and the two-sigma band of fold scores per model."""
    mean, std = F.avg(score), F.stddev_pop(score)
    return scores.groupBy(model).agg(
        F.count(score).alias("folds"),
        F.round(mean, 6).alias("mean"),
        F.round(std, 6).alias("std"),
        F.round(mean - 2 * std, 6).alias("low"),
        F.round(mean + 2 * std, 6).alias("high"),
    )


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def union_results(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack result rows by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
