"""Batch scoring, and foreign models inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.rules import risk_level
from holdfast.schema import ID


def response_columns(scored: DataFrame, now: str, id_col: str = ID) -> DataFrame:
    """Scored rows as prediction records with the time of scoring."""
    p = F.col("p")
    return scored.select(
        F.concat(F.lit("customer_"), F.col(f"`{id_col}`").cast("string")).alias("customer_id"),
        F.col("prediction").cast("int").alias("churn_prediction"),
        F.round(p, 4).alias("churn_probability"),
        F.round(F.lit(1.0) - p, 4).alias("retention_probability"),
        risk_level(p).alias("risk_level"),
        "prediction_source",
        F.lit(now).cast("timestamp").alias("timestamp"),
    )


def score_batch(df: DataFrame, hybrid, now: str, id_col: str = ID) -> DataFrame:
    """Hybrid prediction of every row. Stateless, so it also runs on a streaming frame."""
    return response_columns(hybrid.score(df), now, id_col)


def score_with(
    df: DataFrame,
    load: Callable[[], object],
    parse: Callable[[pd.DataFrame], pd.DataFrame],
    predict: Callable[[pd.DataFrame, object], pd.DataFrame],
    fmt: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Four-hook inference of a foreign model: load once per task, then batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield fmt(predict(parse(batch), model))

    return df.mapInPandas(run, schema)
