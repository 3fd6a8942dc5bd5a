"""Readers: customer files, request bodies, object listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.profile import nan_to_null
from holdfast.schema import CUSTOMER_SCHEMA, CUSTOMER_SPEC, ValidationSpec

BAD_BODY = "body must be an object or an array of objects"


def read_customers(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA):
    """CSV with a header. Column names in the file must match the schema in order."""
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, enforceSchema=False))


def read_any_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and unknown columns, for validation: known columns get their type."""
    raw = spark.read.csv(path, header=True)
    known = {f.name: f.dataType for f in CUSTOMER_SCHEMA.fields}
    return raw.select(*[
        F.expr(f"try_cast(`{c}` AS {known[c].simpleString()})").alias(c) if c in known
        else F.col(f"`{c}`") for c in raw.columns
    ])


def validate_path(spark: SparkSession, path: str, spec: ValidationSpec = CUSTOMER_SPEC):
    """Whether the CSV passes, and the report text."""
    from holdfast.operators import validate as va

    results = va.run_checks(read_any_csv(spark, path), spec).cache()
    passed = va.verdict(results).first()["passed"]
    return passed, va.report_text(results)


def csv_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV files (or folders of part files) inside a folder, sorted.

    Only names are listed; no file is opened.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(conf).listStatus(path)
    names = [e.getPath().getName() for e in entries]
    return sorted(n for n in names if n.endswith(".csv"))


def read_training_dir(spark: SparkSession, folder: str,
                      prefer: Sequence[str] = ("churn", "processed"),
                      schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """The first CSV whose name holds a preferred word, else the first one."""
    names = csv_names(spark, folder)
    if not names:
        raise FileNotFoundError(f"no CSV files found in {folder}")
    chosen = next((n for n in names if any(w in n.lower() for w in prefer)), names[0])
    return read_customers(spark, f"{folder}/{chosen}", schema)


def read_positional(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV without a header; columns by position."""
    return spark.read.schema(schema).csv(path, header=False)


def parse_csv_rows(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Headerless CSV text in a column, as typed columns next to the others."""
    parsed = df.withColumn("_row", F.from_csv(F.col(col), schema))
    return parsed.select(*df.columns, "_row.*")


def parse_json_rows(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON object or array of objects in a column, one row per object.

    Any other body gives one row with ``error`` set. An empty array gives no row.
    """
    body = F.trim(F.col(col))
    shaped = body.startswith("{") | body.startswith("[")
    items = F.from_json(F.when(shaped, body), f"array<struct<_corrupt_record: string, "
                        + _fields(schema) + ">>", {"mode": "PERMISSIVE"})
    broken = (
        F.coalesce(~shaped, F.lit(True)) | items.isNull()
        | F.exists(items, lambda x: x.isNull() | x["_corrupt_record"].isNotNull())
        | F.try_parse_json(body).isNull()
    )
    marked = df.withColumn("_items", items).withColumn(
        "error", F.when(F.coalesce(broken, F.lit(True)), F.lit(BAD_BODY))
    )
    empty = F.array(F.lit(None).cast(items_type(schema)))
    rows = marked.withColumn(
        "_items", F.when(F.col("error").isNull(), F.col("_items")).otherwise(empty)
    )
    out = rows.select(*df.columns, "error", F.posexplode("_items").alias("position", "_item"))
    return out.select(*df.columns, "error", "position", "_item.*").drop("_corrupt_record")


def _fields(schema: str) -> str:
    parsed = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else None
    if parsed is None:
        return schema
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in parsed.fields)


def items_type(schema: str) -> str:
    return f"struct<_corrupt_record: string, {_fields(schema)}>"


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double").csv(path, header=True)


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Name and size of every object under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"),
        F.round(F.col("length") / 1048576.0, 2).alias("size_mb"),
    )
