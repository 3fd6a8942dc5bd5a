"""Request capture and scoring on streams. Both are stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.plans.scoring import score_batch
from holdfast.schema import ID


def sampled(df: DataFrame, pct: int, id_col: str) -> DataFrame:
    """Keep ``pct`` percent of the records, chosen by the hash of their id."""
    slot = F.conv(F.substring(F.md5(F.col(f"`{id_col}`").cast("string")), 1, 8), 16, 10)
    return df.filter(slot.cast("long") % 100 < pct)


def capture(df: DataFrame, pct: int, id_col: str, ts: str = "ts") -> DataFrame:
    """Sampled records with the date they are filed under."""
    return sampled(df, pct, id_col).withColumn("date", F.to_date(F.col(ts)))


def write_capture(stream: DataFrame, path: str, checkpoint: str):
    """Append captured records to Parquet, one folder per date."""
    return (
        stream.writeStream.format("parquet").partitionBy("date").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def score_stream(stream: DataFrame, hybrid, now: str, id_col: str = ID) -> DataFrame:
    """Batch scoring, applied to a stream."""
    return score_batch(stream, hybrid, now, id_col)
