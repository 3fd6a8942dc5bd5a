"""Sinks: processed tables, reports, importance, run log, responses."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.clean import clean_v2, target_first
from holdfast.session import run_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(run_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_processed(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Processed features with a header row, or as Parquet."""
    if fmt == "csv":
        df.write.csv(path, header=True)
    else:
        df.write.format(fmt).save(path)


def write_target_first(df: DataFrame, target: str, path: str) -> None:
    """Target in the first column, no header."""
    target_first(df, target).write.csv(path, header=False)


def materialize_clean(df: DataFrame, path: str) -> None:
    """Copy without missing values; an existing copy stays as it is."""
    clean_v2(df).write.mode("ignore").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One nested row as a JSON document."""
    report.write.json(path)


def write_importance(df: DataFrame, path: str) -> None:
    df.select("feature", "importance").write.csv(path, header=True)


def log_run(rows: DataFrame, path: str) -> None:
    """Append the rows of a run to the experiment log."""
    rows.write.mode("append").partitionBy("experiment").parquet(path)


def to_json_response(df: DataFrame, *ids: str, out: str = "response") -> DataFrame:
    """Every row as a JSON document, next to its id columns."""
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ids])
    return df.select(*[F.col(f"`{c}`") for c in ids], F.to_json(body).alias(out))
