"""Projections, filters and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import is_missing, nan_to_null, q
from holdfast.operators.quantiles import quantiles
from holdfast.schema import CATEGORICAL, ID, TARGET


def drop_id(df: DataFrame, id_col: str = ID) -> DataFrame:
    return df.drop(id_col)


def clean_v1(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows with a label; the label as an integer."""
    return df.filter(~is_missing(df, target)).withColumn(target, q(target).cast("int"))


def clean_v2(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows without any missing value; the label as an integer."""
    return nan_to_null(df).dropna(how="any").withColumn(target, q(target).cast("int"))


def dropped_count(df: DataFrame) -> DataFrame:
    """How many rows ``clean_v2`` keeps and drops."""
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | is_missing(df, c)
    return df.agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"))


def fill0(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return nan_to_null(df).fillna(0, subset=list(cols))


def split_xy(df: DataFrame, target: str = TARGET) -> tuple[list[str], str]:
    """Feature columns and the target column; an absent target is an error."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found in {df.columns}")
    return [c for c in df.columns if c != target], target


def feature_lists(
    df: DataFrame, target: str = TARGET, categorical: Sequence[str] = CATEGORICAL,
    drop: Sequence[str] = (ID,),
) -> tuple[list[str], list[str]]:
    known = {target, *categorical, *drop}
    return [c for c in df.columns if c not in known], list(categorical)


def target_first(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.select(q(target), *[q(c) for c in df.columns if c != target])


def partition_by_mask(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the predicate holds, and all others (unknown counts as no)."""
    hit = F.coalesce(pred, F.lit(False))
    return df.filter(hit), df.filter(~hit)


def in_range(df: DataFrame, col: str, q_low: float, q_high: float) -> DataFrame:
    """Rows in ``[quantile(q_low), quantile(q_high))``; the upper end is left out."""
    low, high = quantiles(df, {col: q(col)}, [q_low, q_high])[col]
    return df.filter((q(col) >= F.lit(low)) & (q(col) < F.lit(high)))


def having_min(grouped: DataFrame, n: int = 100, count: str = "count") -> DataFrame:
    return grouped.filter(F.col(count) > n)


def high_corr(correlations: DataFrame, threshold: float = 0.5, col: str = "corr") -> DataFrame:
    return correlations.filter(F.abs(F.col(col)) > threshold)


def non_numeric(df: DataFrame) -> list[str]:
    """Columns a numeric-only consumer could not read."""
    from pyspark.sql import types as T

    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
