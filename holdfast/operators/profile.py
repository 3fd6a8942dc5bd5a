"""Profiling and exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.quantiles import quantiles


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return q(name).isNull() | F.isnan(q(name))
    return q(name).isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN a null. Spark sorts NaN above all numbers, so a comparison could hold for it."""
    floating = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.nanvl(q(c), F.lit(None)) for c in floating}) if floating else df


def long_rows(agg: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return agg.select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, distinct non-null values and nulls of every column.

    Distinct (column, value) pairs are found by one aggregate that combines before its shuffle, so
    no row is copied for each column through a shuffle.
    """
    cols = df.columns
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(~is_missing(df, c), q(c).cast("string")).alias("v"))
        for i, c in enumerate(cols)
    ])))
    values = pairs.groupBy("i", "v").agg(F.count("*").alias("n"))
    agg = values.agg(
        *[F.count_if((F.col("i") == i) & F.col("v").isNotNull()).alias(f"u{i}")
          for i in range(len(cols))],
        *[F.coalesce(F.sum(F.when((F.col("i") == i) & F.col("v").isNull(), F.col("n"))), F.lit(0))
          .alias(f"n{i}") for i in range(len(cols))],
    )
    kinds = dict(df.dtypes)
    return long_rows(
        agg,
        [(F.lit(c), F.lit(kinds[c]), F.col(f"u{i}"), F.col(f"n{i}")) for i, c in enumerate(cols)],
        ["column", "dtype", "n_unique", "n_null"],
    )


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[q(c) for c in order]).limit(n) if order else df.limit(n)


def _moments(df: DataFrame, cols: Sequence[str], distinct: bool) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(~is_missing(df, c), q(c))
        aggs += [
            F.count(v).alias(f"c{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}"),
        ]
        if distinct:
            aggs.append(F.countDistinct(v).alias(f"u{i}"))
    return df.agg(*aggs)


def describe_exact(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    found = quantiles(df, {c: q(c) for c in cols}, [0.25, 0.5, 0.75])
    agg = _moments(df, cols, distinct=False)

    def r(c):
        return F.round(c.cast("double"), digits)

    return long_rows(
        agg,
        [
            (F.lit(c), F.col(f"c{i}"), r(F.col(f"m{i}")), r(F.col(f"s{i}")), r(F.col(f"lo{i}")),
             *[r(F.lit(x)) for x in found[c]], r(F.col(f"hi{i}")))
            for i, c in enumerate(cols)
        ],
        ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"],
    )


def distribution(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Range, mean, sample deviation, median and distinct count per column."""
    found = quantiles(df, {c: q(c) for c in cols}, [0.5])
    agg = _moments(df, cols, distinct=True)

    def r(c):
        return F.round(c.cast("double"), digits)

    return long_rows(
        agg,
        [
            (F.lit(c), r(F.col(f"lo{i}")), r(F.col(f"hi{i}")), r(F.col(f"m{i}")),
             r(F.col(f"s{i}")), r(F.lit(found[c][0])), F.col(f"u{i}"))
            for i, c in enumerate(cols)
        ],
        ["column", "min", "max", "mean", "std", "median", "n_unique"],
    )


def null_counts(df: DataFrame) -> DataFrame:
    agg = df.agg(*[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return long_rows(
        agg,
        [(F.lit(c), F.col(f"n{i}")) for i, c in enumerate(df.columns)],
        ["column", "n_null"],
    )


def null_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("n_null").alias("n_null"))


def columns_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the string columns."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return (
        df.filter(~is_missing(df, col)).groupBy(q(col).alias("value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def class_rate(df: DataFrame, target: str) -> DataFrame:
    return df.agg(
        F.count(q(target)).alias("n"),
        F.sum(q(target)).cast("long").alias("positives"),
        F.round(F.avg(q(target)), 6).alias("rate"),
        F.round(F.try_divide(F.sum(q(target)) * 100.0, F.count("*")), 6).alias("pct"),
    )


def class_shares(df: DataFrame, target: str) -> DataFrame:
    counts = df.filter(~is_missing(df, target)).groupBy(q(target).alias("value")).agg(
        F.count("*").alias("count")
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", F.round(F.col("count") * 100.0 / total, 6))


def find_target(df: DataFrame, token: str = "churn") -> str | None:
    """First column whose lower-cased name holds the token."""
    return next((c for c in df.columns if token.lower() in c.lower()), None)


def mean_row(df: DataFrame, cols: Sequence[str], digits: int = 4) -> DataFrame:
    return df.agg(*[F.round(F.avg(q(c)), digits).alias(c) for c in cols])


def box_stats(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Box-plot numbers of every column per class of ``by``.

    Whiskers end at the last value inside 1.5 interquartile ranges of the box.
    """
    classes = sorted(r[0] for r in df.select(q(by)).distinct().dropna().collect())
    groups = [(c, k) for c in cols for k in classes]
    values = {
        str(i): F.when(q(by) == F.lit(k), q(c).cast("double"))
        for i, (c, k) in enumerate(groups)
    }
    found = quantiles(df, values, [0.25, 0.5, 0.75])
    aggs, rows = [], []
    for i, (c, k) in enumerate(groups):
        q1, q2, q3 = found[str(i)]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        v = values[str(i)]
        inside = F.when(v.between(low, high), v)
        aggs += [
            F.count(v).alias(f"n{i}"), F.min(inside).alias(f"lo{i}"),
            F.max(inside).alias(f"hi{i}"),
            F.count_if((v < low) | (v > high)).alias(f"out{i}"),
        ]
        rows.append((
            F.lit(c), F.lit(k), F.col(f"n{i}"),
            F.round(F.lit(q1), 6), F.round(F.lit(q2), 6), F.round(F.lit(q3), 6),
            F.round(F.col(f"lo{i}"), 6), F.round(F.col(f"hi{i}"), 6), F.col(f"out{i}"),
        ))
    return long_rows(
        df.agg(*aggs), rows,
        ["column", "class", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers"],
    )
