"""Usage cost of endpoints and training jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import formatted, hours_between
from holdfast.operators.joins import endpoint_variants, lookup
from holdfast.operators.rank import recent_jobs
from holdfast.schema import OVERSIZED

# Prices and defaults for entries the price list lacks.
ENDPOINT_DEFAULT_PRICE = 0.1
JOB_DEFAULT_PRICE = 0.115
DEFAULT_TYPE = "ml.t2.medium"
TYPICAL_SHARE = 0.7


def endpoint_costs(endpoints: DataFrame, configs: DataFrame, prices: DataFrame,
                   now: str) -> DataFrame:
    """Hourly price over all variants, runtime and cost so far of endpoints in service."""
    live = endpoints.filter(F.col("status") == "InService")
    variants = endpoint_variants(live, configs).withColumns({
        "has_variant": F.col("variant").isNotNull(),
        "priced_type": F.coalesce("variant.instance_type", F.lit(DEFAULT_TYPE)),
        "n": F.coalesce("variant.instance_count", F.lit(1)),
    })
    priced = lookup(
        variants, prices, "priced_type", "hourly", ENDPOINT_DEFAULT_PRICE, dim_key="instance_type"
    )
    cost = F.when(F.col("has_variant"), F.col("hourly") * F.col("n")).otherwise(0.0)
    first = F.min_by(F.struct("variant.instance_type", "n"), F.coalesce("position", F.lit(0)))
    per = priced.groupBy("name", "status", "created_at").agg(
        F.sum(cost).alias("hourly"),
        F.max("has_variant").alias("has_variant"),
        first.alias("first"),
    )
    hours = F.coalesce(hours_between(F.col("created_at"), F.lit(now).cast("timestamp")), F.lit(0.0))
    return per.select(
        F.col("name").alias("endpoint_name"), "status", "created_at",
        F.when(F.col("has_variant"), F.col("first.instance_type")).otherwise("unknown")
        .alias("instance_type"),
        F.col("first.n").alias("instance_count"),
        F.round("hourly", 4).alias("hourly_cost_usd"),
        F.round(hours, 2).alias("runtime_hours"),
        F.round(F.col("hourly") * hours, 2).alias("total_cost_usd"),
    )


def job_costs(jobs: DataFrame, prices: DataFrame) -> DataFrame:
    """Duration and cost per training job; jobs without start or end cost nothing."""
    filled = jobs.withColumns({
        "instance_type": F.coalesce("instance_type", F.lit("ml.m5.large")),
        "instance_count": F.coalesce("instance_count", F.lit(1)),
    })
    priced = lookup(filled, prices, "instance_type", "hourly", JOB_DEFAULT_PRICE)
    hours = F.coalesce(hours_between(F.col("started"), F.col("ended")), F.lit(0.0))
    return priced.select(
        "job", "status", "instance_type", "instance_count",
        F.round(hours * 60.0, 2).alias("duration_minutes"),
        F.col("hourly").alias("hourly_rate_usd"),
        F.round(F.col("hourly") * F.col("instance_count") * hours, 4).alias("total_cost_usd"),
        "created",
    )


def _cents(c: Column) -> Column:
    """Add already rounded amounts exactly, whatever the order of rows."""
    return F.sum(c.cast("decimal(20,4)")).cast("double")


def cost_summary(endpoints: DataFrame, jobs: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Totals, projections and the five latest jobs, from costed endpoints and jobs."""
    recent = recent_jobs(jobs, now, days)
    ep = endpoints.agg(
        F.count("*").alias("n"),
        F.coalesce(_cents(F.col("total_cost_usd")), F.lit(0.0)).alias("cost"),
        F.coalesce(_cents(F.col("hourly_cost_usd")), F.lit(0.0)).alias("hourly"),
    )
    tr = recent.agg(F.struct(
        F.count("*").alias("n"),
        F.coalesce(_cents(F.col("total_cost_usd")), F.lit(0.0)).alias("cost"),
    ).alias("t")).scalar()
    last = recent.limit(5).agg(
        F.sort_array(F.collect_list(F.struct("created", "job")), asc=False).alias("jobs")
    ).select(F.array_join(F.transform("jobs", lambda x: x["job"]), ",")).scalar()
    return ep.select(
        F.lit(days).alias("period_days"),
        F.col("n").alias("active_endpoints"),
        F.round("cost", 2).alias("endpoint_total_usd"),
        F.round("hourly", 4).alias("hourly_rate_usd"),
        F.round(F.col("hourly") * 24, 2).alias("daily_rate_usd"),
        F.round(F.col("hourly") * 24 * 30, 2).alias("monthly_projection_usd"),
        tr["n"].alias("jobs_count"),
        F.round(tr["cost"], 2).alias("training_total_usd"),
        F.round(F.col("cost") + tr["cost"], 2).alias("total_cost_usd"),
        last.alias("recent_jobs"),
    )


def cost_recommendations(endpoints: DataFrame) -> DataFrame:
    """Advice per costed endpoint, and two general rows."""
    # fixed values: wording of the advice
    hourly = F.col("hourly_cost_usd")
    name = F.col("endpoint_name")
    running = F.when(F.col("runtime_hours") > 24, F.struct(
        F.lit("warning").alias("type"), name.alias("resource"),
        F.format_string("Endpoint running for %.1f hours", "runtime_hours").alias("issue"),
        F.lit("Delete endpoint when not in use to save costs").alias("recommendation"),
        F.round(hourly * 24 * 30, 2).alias("savings_usd"),
        F.lit(None).cast("string").alias("savings_note"),
    ))
    oversized = F.when(F.col("instance_type").isin(OVERSIZED), F.struct(
        F.lit("optimization").alias("type"), name.alias("resource"),
        F.format_string("Using %s which may be oversized", "instance_type").alias("issue"),
        F.lit("Consider ml.t2.medium or ml.t3.medium for low-traffic endpoints")
        .alias("recommendation"),
        F.round((hourly - 0.05) * 24 * 30, 2).alias("savings_usd"),
        F.lit(None).cast("string").alias("savings_note"),
    ))
    specific = endpoints.select(F.inline(F.array_compact(F.array(running, oversized))))
    general = endpoints.sparkSession.createDataFrame([
        ("best_practice", "all", "General cost optimization",
         "Use batch transform for batch predictions instead of real-time endpoints",
         None, "Variable based on usage pattern"),
        ("best_practice", "all", "Development best practice",
         "Always delete endpoints after testing. Use: delete_endpoint()",
         None, "Up to $40/month per endpoint"),
    ], specific.schema)
    return specific.unionByName(general)


def idle_endpoints(endpoints: DataFrame, max_hours: float = 24) -> DataFrame:
    """Endpoints that run longer than allowed; a list of candidates, nothing is deleted."""
    return endpoints.filter(F.col("runtime_hours") > max_hours)


def tuning_cost(plans: DataFrame, prices: DataFrame) -> DataFrame:
    """Highest and typical cost of tuning plans ``(instance_type, max_jobs, minutes)``."""
    priced = lookup(plans, prices, "instance_type", "hourly", JOB_DEFAULT_PRICE)
    most = F.col("max_jobs") * F.col("hourly") * (F.col("minutes") / 60.0)
    return priced.select(
        *plans.columns,
        F.col("hourly").alias("hourly_rate"),
        F.round(most, 2).alias("max_cost_usd"),
        F.round(most * TYPICAL_SHARE, 2).alias("typical_cost_usd"),
    )


def cost_report(summary: DataFrame, recommendations: DataFrame) -> DataFrame:
    """The text report as numbered lines; the first five recommendations are shown."""
    one = summary.select(F.posexplode(F.array(
        F.lit("COST REPORT"),
        F.format_string("Summary (Last %d days)", "period_days"),
        F.format_string("Active Endpoints: %d", "active_endpoints"),
        F.format_string("Training Jobs: %d", "jobs_count"),
        F.format_string("Total Cost: $%.2f", "total_cost_usd"),
        F.lit("Endpoint Costs"),
        F.format_string("Current Total: $%.2f", "endpoint_total_usd"),
        F.format_string("Hourly Rate: $%.4f", "hourly_rate_usd"),
        F.format_string("Daily Rate: $%.2f", "daily_rate_usd"),
        F.format_string("Monthly Projection: $%.2f", "monthly_projection_usd"),
        F.lit("Training Costs"),
        F.format_string("Jobs Count: %d", "jobs_count"),
        F.format_string("Total: $%.2f", "training_total_usd"),
        F.lit("Recommendations"),
    )).alias("line", "text"))
    first = recommendations.orderBy(
        F.desc(F.col("type") != "best_practice"), "resource", F.desc("type"), "issue"
    ).limit(5)
    shown = first.agg(F.collect_list(F.concat(
        F.lit("["), F.upper("type"), F.lit("] "), F.col("recommendation"),
        F.coalesce(
            formatted("   Potential savings: $%.2f/month", F.col("savings_usd")), F.lit("")
        ),
    )).alias("texts"))
    tail = shown.select(F.posexplode("texts").alias("line", "text"))
    return one.unionByName(tail.withColumn("line", F.col("line") + 14))
