"""Customer schema, validation limits and other fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = "CustomerID"
TARGET = "Churn"

NUMERIC = [
    "Age", "Tenure", "Usage Frequency", "Support Calls",
    "Payment Delay", "Total Spend", "Last Interaction",
]
CATEGORICAL = ["Gender", "Subscription Type", "Contract Length"]

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Usage Frequency", T.IntegerType()),
    T.StructField("Support Calls", T.IntegerType()),
    T.StructField("Payment Delay", T.IntegerType()),
    T.StructField("Subscription Type", T.StringType()),
    T.StructField("Contract Length", T.StringType()),
    T.StructField("Total Spend", T.DoubleType()),
    T.StructField("Last Interaction", T.IntegerType()),
    T.StructField("Churn", T.IntegerType()),
])

# Allowed categories and inclusive numeric bounds.
CATEGORIES = {
    "Gender": ["Male", "Female"],
    "Subscription Type": ["Basic", "Standard", "Premium"],
    "Contract Length": ["Monthly", "Quarterly", "Annual"],
}
BOUNDS = {
    "Age": (18, 100),
    "Tenure": (0, 100),
    "Usage Frequency": (0, 50),
    "Support Calls": (0, 20),
    "Payment Delay": (0, 60),
    "Total Spend": (0, 10000),
    "Last Interaction": (0, 365),
}

# Right-closed bin edges, lowest edge included.
TENURE_EDGES = [0, 6, 12, 24, 36, 61]
AGE_EDGES = [0, 25, 35, 45, 55, 100]
DELAY_EDGES = [0, 5, 10, 15, 20, 25, 30]

# Spend limit used when no threshold has been fitted.
FIXED_SPEND_LIMIT = 405.0
SPEND_QUANTILE = 0.20

# On-demand price per instance hour, US dollars.
HOURLY_PRICE = {
    "ml.m5.large": 0.115,
    "ml.m5.xlarge": 0.23,
    "ml.m5.2xlarge": 0.461,
    "ml.m5.4xlarge": 0.922,
    "ml.c5.large": 0.102,
    "ml.c5.xlarge": 0.204,
    "ml.c5.2xlarge": 0.408,
    "ml.p3.2xlarge": 3.825,
    "ml.p3.8xlarge": 14.688,
    "ml.t2.medium": 0.056,
    "ml.t2.large": 0.111,
    "ml.t3.medium": 0.05,
    "serverless": 0.00001667,
}
# Prices known to the tuning-cost estimate.
TUNING_PRICE = {
    "ml.m5.large": 0.115,
    "ml.m5.xlarge": 0.23,
    "ml.m5.2xlarge": 0.461,
    "ml.m5.4xlarge": 0.922,
    "ml.t2.medium": 0.056,
    "ml.t3.medium": 0.05,
}
OVERSIZED = ["ml.m5.xlarge", "ml.m5.2xlarge", "ml.m5.4xlarge"]


@dataclass(frozen=True)
class ValidationSpec:
    """What a table has to look like to pass validation."""

    columns: list[str] = field(default_factory=lambda: CUSTOMER_SCHEMA.fieldNames())
    categories: dict = field(default_factory=lambda: dict(CATEGORIES))
    bounds: dict = field(default_factory=lambda: dict(BOUNDS))
    id_col: str = ID
    target: str = TARGET


CUSTOMER_SPEC = ValidationSpec()
