"""Tables derived from the driver's Parquet files."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.schema import CUSTOMER_SCHEMA, HOURLY_PRICE
from holdfast.session import staged

CUTOFF = "2001-02-01"
ENDPOINTS = 3
LEDGER_NOW = "2001-08-15 00:00:00"


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table. Its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in the twelve-column customer schema.

    Features use orders before the cut-off date, the label uses orders from it on.
    Line items are counted per order before they meet the orders, and orders are summed per
    customer before they meet the customers, so every join has a unique side.
    Money is summed in whole cents: the sum does not depend on the order of rows.
    """
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    returned = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n_returned"))
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority",
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("placed"),
    )
    before = F.col("placed") < cutoff
    per_customer = (
        orders.join(returned, "o_orderkey", "left")
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(before, F.col("placed"))).alias("first_before"),
            F.max(F.when(before, F.col("placed"))).alias("last_before"),
            F.count_if(before).alias("n_before"),
            F.count_if(before & (F.col("o_orderpriority") == "1-URGENT")).alias("n_urgent"),
            F.sum(F.when(before, F.coalesce("n_returned", F.lit(0)))).alias("n_returned"),
            F.sum(F.when(before, F.col("cents"))).alias("cents"),
            F.count_if(~before).alias("n_after"),
        )
    )
    cutoff_day = F.lit(CUTOFF).cast("date")
    days = F.datediff(cutoff_day, F.col("first_before").cast("date"))
    key = F.col("c_custkey")
    bal = F.col("c_acctbal")
    segment = F.col("c_mktsegment")
    frame = (
        table(spark, sf_dir, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_name").alias("CustomerID"),
            (F.lit(18) + key % 63).alias("Age"),
            F.when(key % 2 == 0, "Male").otherwise("Female").alias("Gender"),
            F.floor(F.floor(days / 35) * (1 + key % 4) / 4).alias("Tenure"),
            F.coalesce("n_before", F.lit(0)).alias("Usage Frequency"),
            F.coalesce("n_urgent", F.lit(0)).alias("Support Calls"),
            F.coalesce("n_returned", F.lit(0)).alias("Payment Delay"),
            F.when(bal < 2500, "Basic").when(bal < 6000, "Standard").otherwise("Premium")
            .alias("Subscription Type"),
            F.when(segment == "BUILDING", "Monthly")
            .when(segment.isin("AUTOMOBILE", "MACHINERY"), "Quarterly")
            .otherwise("Annual").alias("Contract Length"),
            (F.col("cents") / 100.0 / 1000.0).alias("Total Spend"),
            F.datediff(cutoff_day, F.col("last_before").cast("date")).alias("Last Interaction"),
            F.when(F.coalesce("n_after", F.lit(0)) == 0, 1).otherwise(0).alias("Churn"),
        )
    )
    return frame.select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in CUSTOMER_SCHEMA.fields]
    )


def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile as a written table, for jobs that read it several times.

    The joins and the aggregation of line items then run once; later passes read few columns.
    """
    return staged(customer_profile(spark, sf_dir), "profile")


def faulty_profile(profile: DataFrame) -> DataFrame:
    """The profile with planted faults of every kind the validator looks for."""
    age = F.col("Age")
    faulty = profile.unionByName(profile.filter(age == 30)).withColumns({
        "Gender": F.when(age == 40, "Unknown").otherwise(F.col("Gender")),
        "Subscription Type": F.when(age == 41, "Enterprise").when(age != 42, F.col("`Subscription Type`")),
        "Total Spend": F.when(~age.between(60, 65), F.col("`Total Spend`")),
        "Churn": F.when((age < 70) & (age != 33), 0).otherwise(F.col("Churn")),
        "Region": F.lit("none"),
    })
    return faulty.withColumn("Age", F.when(age == 18, 150).when(age == 42, 101).otherwise(age))


def planted_profile(profile: DataFrame, cut: float = 3.0) -> DataFrame:
    """The profile with a label that depends on calls, delay and tenure, plus hashed noise.

    The label of the plain profile is close to independent of its features, so models are trained
    on this one.
    """
    noise = F.conv(F.substring(F.md5(F.col("CustomerID")), 1, 6), 16, 10).cast("double") / 2**24
    drive = (
        0.6 * F.col("`Support Calls`") + 0.2 * F.col("`Payment Delay`")
        - 0.05 * F.coalesce("Tenure", F.lit(0)) + 2.0 * noise
    )
    return profile.withColumn("Churn", (drive > cut).cast("int"))


def closed_form_score(
    calls="Support Calls", delay="Payment Delay", lift: float = 0.0, digits: int | None = 6
):
    """Model-free probability with ties, rounded so that equal inputs group together."""
    z = (
        F.lit(0.1) * (F.col(f"`{calls}`") - F.lit(2))
        + F.lit(0.05) * (F.col(f"`{delay}`") - F.lit(10))
        + F.lit(float(lift))
    )
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return p if digits is None else F.round(p, digits)


def scored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile with ``label``, ``p`` and ``prediction`` from the closed-form score."""
    return (
        profile_table(spark, sf_dir)
        .withColumn("p", closed_form_score())
        .withColumn("label", F.col("Churn"))
        .withColumn("prediction", (F.col("p") > 0.5).cast("int"))
    )


def endpoint_metrics(events: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """Events as ``(ts, endpoint, metric, value)``; works on batch and streaming frames.

    ``only`` names the metrics to make; a filter after the fact would build all of them first.

    Every event is an invocation, an ``error`` event also a 5XX error. Latency (microseconds),
    CPU, memory and disk are read from the event value.
    """
    value = F.col("value")
    readings = {
        "Invocations": F.lit(1.0),
        "Invocation5XXErrors": F.when(F.col("event_type") == "error", 1.0),
        "ModelLatency": value * 20000.0,
        "CPUUtilization": F.least(value, F.lit(100.0)),
        "MemoryUtilization": F.least(value * 1.25, F.lit(100.0)),
        "DiskUtilization": F.least(value * 0.5, F.lit(100.0)),
    }
    metrics = F.array(*[
        F.struct(F.lit(name).alias("metric"), v.alias("value")) for name, v in readings.items()
        if only is None or name in only
    ])
    return (
        events.select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("endpoint-"), (F.col("user_id") % ENDPOINTS).cast("string"))
            .alias("endpoint"),
            F.explode(metrics).alias("m"),
        )
        .select("ts", "endpoint", "m.metric", "m.value")
        .filter(F.col("value").isNotNull())
    )


def metrics_table(
    spark: SparkSession, sf_dir: str, only: Collection[str] | None = None
) -> DataFrame:
    return endpoint_metrics(table(spark, sf_dir, "events"), only)


LEDGER_TYPES = [
    "ml.t2.medium", "ml.m5.large", "ml.m5.xlarge", "ml.c5.xlarge",
    "ml.m5.4xlarge", "ml.t3.medium", "ml.unlisted",
]


def _instance(key):
    names = F.array(*[F.lit(t) for t in LEDGER_TYPES])
    return F.get(names, (key % len(LEDGER_TYPES)).cast("int"))


def _shifted(ts, millis):
    return F.timestamp_micros(F.unix_micros(ts) + millis * 1000)


def ledger_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endpoint per supplier: name, status, creation time, configuration name."""
    key = F.col("s_suppkey")
    now = F.lit(LEDGER_NOW).cast("timestamp")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(key % 4 == 3, "Deleting").otherwise("InService").alias("status"),
        F.when(key % 10 != 9, _shifted(now, -((key % 100000) * 2221007 + 677003)))
        .alias("created_at"),
        F.concat(F.lit("config-"), key.cast("string")).alias("config"),
    )


def ledger_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration of each endpoint: an ordered list of (instance type, count) variants."""
    key = F.col("s_suppkey")
    first = F.struct(
        _instance(key).alias("instance_type"), (1 + key % 3).cast("int").alias("instance_count")
    )
    second = F.struct(
        _instance(key + 2).alias("instance_type"), F.lit(1).alias("instance_count")
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("config-"), key.cast("string")).alias("config"),
        F.when(key % 17 == 5, F.filter(F.array(first), lambda _: F.lit(False)))
        .when(key % 2 == 0, F.array(first, second))
        .otherwise(F.array(first)).alias("variants"),
    )


def ledger_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training job per order; open orders have no end time."""
    key = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    started = _shifted(created, (key % 60) * 60000)
    ended = _shifted(started, (key % 7200 + 30) * 1000 + 7)
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("job-"), key.cast("string")).alias("job"),
        F.when(status == "F", "Completed").when(status == "O", "InProgress")
        .otherwise("Stopped").alias("status"),
        _instance(key).alias("instance_type"),
        (1 + key % 2).cast("int").alias("instance_count"),
        created.alias("created"),
        started.alias("started"),
        F.when(status != "O", ended).alias("ended"),
        F.when(status == "F", F.col("o_totalprice") / 1000000.0).alias("objective"),
    )


def price_table(spark: SparkSession, prices: dict = HOURLY_PRICE) -> DataFrame:
    """The fixed price list as a table."""
    return spark.createDataFrame(
        [(k, float(v)) for k, v in prices.items()], "instance_type string, hourly double"
    )
