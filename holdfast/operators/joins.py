"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import nan_to_null, q


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Pairs of identical rows across two tables, missing values being equal.

    Both tables are counted in one aggregate: one shuffle, no join, and copies never multiply.
    """
    shared = [c for c in train.columns if c in test.columns]

    def side(df: DataFrame, is_train: int) -> DataFrame:
        return nan_to_null(df.select(*[q(c) for c in shared])).withColumn("_train", F.lit(is_train))

    both = side(train, 1).unionByName(side(test, 0)).groupBy(*[q(c) for c in shared]).agg(
        F.sum("_train").alias("_n_train"), F.sum(1 - F.col("_train")).alias("_n_test"))
    pairs = F.sum(F.col("_n_train") * F.col("_n_test"))
    return both.agg(F.coalesce(pairs, F.lit(0)).cast("long").alias("overlapping"))


def concat_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Put the columns of two tables side by side, matched by row id."""
    return a.join(b, key, "inner")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: float,
           out: str | None = None, dim_key: str | None = None) -> DataFrame:
    """Add ``value`` of the dimension, or the default for unknown keys.

    The dimension must have one row per key. Spark broadcasts it when its size allows.
    """
    out = out or value
    side = dim.select(q(dim_key or key).alias("_k"), q(value).alias("_v"))
    return (
        df.join(side, q(key) == F.col("_k"), "left")
        .withColumn(out, F.coalesce("_v", F.lit(default)))
        .drop("_k", "_v")
    )


def endpoint_variants(endpoints: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per endpoint and variant; endpoints without variants keep one empty row."""
    return (
        endpoints.join(configs, "config", "inner")
        .select("*", F.posexplode_outer("variants").alias("position", "variant"))
        .drop("variants")
    )


def merge_branches(rule: DataFrame, ml: DataFrame) -> DataFrame:
    """Put rule-scored and model-scored rows back into one table."""
    return rule.unionByName(ml)
