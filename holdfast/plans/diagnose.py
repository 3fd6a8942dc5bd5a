"""Leakage diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.features import V1_FEATURES, engineer_v1
from holdfast.operators import metrics as mx
from holdfast.operators import profile as pr
from holdfast.operators import stats
from holdfast.operators.clean import clean_v2, feature_lists, fill0
from holdfast.operators.joins import overlap
from holdfast.operators.prep import dummies
from holdfast.operators.split import random_split, shuffle_labels, stratified_split
from holdfast.plans.models import make_model
from holdfast.schema import CATEGORICAL, ID, NUMERIC, TARGET
from holdfast.session import staged

FOREST = {"numTrees": 100, "maxDepth": 10}
SUSPICIOUS_F1 = 0.7


def _encoded(df: DataFrame, target: str, id_col: str) -> DataFrame:
    return dummies(clean_v2(df, target), exclude=[id_col])


def _fit_score(marked: DataFrame, cols: Sequence[str], label: str, algorithm: str, params: dict):
    """Train on flagged rows, test on the others."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="features").transform(
        marked.withColumn("label", F.col(f"`{label}`").cast("double"))
    ).select("features", "label", "is_train")
    model = make_model(algorithm, params).fit(rows.filter("is_train"))
    scored = model.transform(rows.filter("NOT is_train"))
    found = mx.basic_metrics(scored.select("label", "prediction")).first().asDict()
    return model, found


def baseline(df: DataFrame, params: dict = FOREST, target: str = TARGET, id_col: str = ID,
             k: int = 15):
    """Forest on raw features: metrics and the leading features."""
    data = stratified_split(staged(_encoded(df, target, id_col), "raw"), target, id_col=id_col)
    cols = [c for c in data.columns if c not in (target, id_col, "is_train")]
    model, found = _fit_score(data, cols, target, "random_forest", params)
    ranked = sorted(
        zip(cols, (float(v) for v in model.featureImportances.toArray())),
        key=lambda x: (-x[1], x[0]),
    )
    top = df.sparkSession.createDataFrame(ranked[:k], "feature string, importance double")
    return found, top, data


def shuffled_target_test(df: DataFrame, params: dict = FOREST, target: str = TARGET,
                         id_col: str = ID) -> dict:
    """The same forest on permuted labels; anything above chance points to leakage."""
    mixed = shuffle_labels(_encoded(df, target, id_col), target, id_col=id_col)
    data = random_split(staged(mixed, "shuffled"), id_col=id_col)
    cols = [c for c in data.columns if c not in (target, id_col, "is_train", "shuffled")]
    return _fit_score(data, cols, "shuffled", "random_forest", params)[1]


def single_feature_power(df: DataFrame, cols: Sequence[str] = NUMERIC, target: str = TARGET,
                         algorithm: str = "decision_tree", params: dict | None = None,
                         id_col: str = ID, threads: int = 4) -> DataFrame:
    """F1 of a small model per feature. The jobs run side by side on one written table."""
    wanted = [F.col(f"`{c}`") for c in (id_col, target, *cols)]
    table = staged(fill0(df, cols).select(*wanted), "single")
    data = stratified_split(table, target, id_col=id_col)

    def one(c):
        return c, _fit_score(data, [c], target, algorithm, params or {"maxDepth": 5})[1]["f1"]

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(inheritable_thread_target(df.sparkSession)(one), cols))
    rows = [(c, f1, f1 > SUSPICIOUS_F1) for c, f1 in found]
    return df.sparkSession.createDataFrame(rows, "feature string, f1 double, suspicious boolean")


def verdict(f1: Column) -> Column:
    return F.when(f1 > 0.95, "too easy").when(f1 > 0.85, "reasonable").otherwise("weak")


def leakage_report(df: DataFrame, params: dict = FOREST, target: str = TARGET,
                   id_col: str = ID) -> DataFrame:
    """All sections as ``(section, item, key, value)`` rows."""
    def rows(frame: DataFrame, section: str, item: Column, keys: Sequence[str]) -> DataFrame:
        return pr.long_rows(
            frame,
            [(F.lit(section), item.cast("string"), F.lit(k), F.col(f"`{k}`").cast("double"))
             for k in keys],
            ["section", "item", "key", "value"],
        )

    def numbers(section: str, item: str, values: dict) -> DataFrame:
        spark = df.sparkSession
        return spark.createDataFrame(
            [(section, item, k, float(v)) for k, v in values.items()],
            "section string, item string, key string, value double",
        )

    table = F.lit("table")
    name = F.col("column")
    raw, top, encoded = baseline(df, params, target, id_col)
    shuffled = shuffled_target_test(df, params, target, id_col)
    train = encoded.filter("is_train").drop("is_train", id_col, target)
    test = encoded.filter("NOT is_train").drop("is_train", id_col, target)
    parts = [
        rows(pr.column_profile(df), "1 columns", name, ["n_unique", "n_null"]),
        rows(pr.class_rate(df, target), "1 classes", table, ["n", "rate"]),
        rows(stats.target_corr(df, NUMERIC, target), "2 correlation", F.col("feature"), ["corr"]),
        rows(stats.dup_rows(df), "3 duplicates", table, ["duplicates"]),
        rows(stats.dup_keys(df, id_col), "3 duplicates", F.lit(id_col), ["duplicates"]),
        numbers("4 raw baseline", "forest", raw),
        rows(top, "4 raw baseline", F.col("feature"), ["importance"]),
        rows(stats.target_corr(engineer_v1(df), [*NUMERIC, *V1_FEATURES], target),
             "5 engineered correlation", F.col("feature"), ["corr"]),
        numbers("6 shuffled target", "forest", shuffled),
        rows(overlap(train, test), "7 overlap", table, ["overlapping"]),
        rows(single_feature_power(df, NUMERIC, target, id_col=id_col), "8 single feature",
             F.col("feature"), ["f1"]),
        rows(pr.distribution(df, NUMERIC), "9 distribution", name,
             ["min", "max", "mean", "std", "median"]),
        rows(stats.rate_by_many(df, CATEGORICAL, target), "10 categories",
             F.concat_ws("=", "column", "value"), ["rate", "count"]),
    ]
    return reduce(DataFrame.unionByName, parts)


__all__ = ["baseline", "shuffled_target_test", "single_feature_power", "verdict",
           "leakage_report", "feature_lists"]
