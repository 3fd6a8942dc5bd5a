"""Run a stream over everything that is there, and return the table it wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from holdfast.sources.sinks import fresh_path
from holdfast.streaming import STATE_CONF


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int | None = None) -> DataFrame:
    """The events file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/events*.parquet")


def drained(stream: DataFrame, name: str, partition_by: Sequence[str] = (),
            timeout_s: int | None = None) -> DataFrame:
    """Process all input once, with exactly-once file output in the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        writer = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        )
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        query = writer.start()
        if timeout_s is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout_s):
            query.stop()
            raise TimeoutError(f"stream {name} did not finish in {timeout_s} seconds")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
