"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "holdfast", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # stack traces per column expression cost more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is required, because every executor has to reach the folder.
    A local master may run without it; then a fresh folder of this process is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            folder = tempfile.mkdtemp(prefix="run-holdfast-")
            spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """Folder of this application under the shared one; it is deleted when the JVM ends."""
    sc = spark.sparkContext
    path = os.path.join(shared_dir(spark), "holdfast", sc.applicationId)
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Later passes prune columns on the Parquet copy, and a lost executor only re-reads it.
    """
    spark = df.sparkSession
    path = os.path.join(run_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
