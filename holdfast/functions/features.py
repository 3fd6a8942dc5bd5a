"""Derived feature columns. All are plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import nan_to_null
from holdfast.schema import AGE_EDGES, TENURE_EDGES


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def _ratio(top, bottom) -> Column:
    return _col(top) / (_col(bottom) + F.lit(1))


def _flag(condition: Column) -> Column:
    """1 or 0. Missing values give 0; make NaN a null first (``nan_to_null``)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def spend_per_tenure(spend="Total Spend", tenure="Tenure") -> Column:
    return _ratio(spend, tenure)


def support_per_tenure(calls="Support Calls", tenure="Tenure") -> Column:
    return _ratio(calls, tenure)


def usage_per_tenure(usage="Usage Frequency", tenure="Tenure") -> Column:
    return _ratio(usage, tenure)


def delay_per_tenure(delay="Payment Delay", tenure="Tenure") -> Column:
    return _ratio(delay, tenure)


def cost_per_usage(spend="Total Spend", usage="Usage Frequency") -> Column:
    return _ratio(spend, usage)


def recency_score(last="Last Interaction") -> Column:
    return _col(last) / F.lit(30.0)


def risk_score(calls="Support Calls", delay="Payment Delay") -> Column:
    return _col(calls) * _col(delay)


def frustration_index(calls="Support Calls", usage="Usage Frequency") -> Column:
    return _ratio(calls, usage)


def is_high_support(calls="Support Calls") -> Column:
    return _flag(_col(calls) >= 7)


def is_payment_late(delay="Payment Delay") -> Column:
    return _flag(_col(delay) >= 15)


def is_low_usage(usage="Usage Frequency") -> Column:
    return _flag(_col(usage) <= 5)


def is_new_customer(tenure="Tenure") -> Column:
    return _flag(_col(tenure) <= 6)


def is_long_tenure(tenure="Tenure") -> Column:
    return _flag(_col(tenure) >= 40)


def is_senior(age="Age") -> Column:
    return _flag(_col(age) >= 50)


def age_tenure_ratio(age="Age", tenure="Tenure") -> Column:
    return _ratio(age, tenure)


def cut(col, edges, labels=None, include_lowest: bool = True) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; null outside of all bins."""
    edges = list(edges)
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must increase: {edges}")
    c = _col(col)
    labels = [float(i) for i in range(len(edges) - 1)] if labels is None else list(labels)
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    low = c >= F.lit(edges[0]) if include_lowest else c > F.lit(edges[0])
    pairs = list(zip(edges[1:], labels))
    ladder = reduce(
        lambda acc, pair: acc.when(low & (c <= F.lit(pair[0])), F.lit(pair[1])),
        pairs[1:],
        F.when(low & (c <= F.lit(pairs[0][0])), F.lit(pairs[0][1])),
    )
    return ladder


def tenure_bucket(tenure="Tenure") -> Column:
    return cut(tenure, TENURE_EDGES)


def age_group(age="Age") -> Column:
    return cut(age, AGE_EDGES)


V1_FEATURES = {
    "spend_per_tenure": spend_per_tenure,
    "support_per_tenure": support_per_tenure,
    "usage_per_tenure": usage_per_tenure,
    "delay_per_tenure": delay_per_tenure,
    "cost_per_usage": cost_per_usage,
    "recency_score": recency_score,
    "risk_score": risk_score,
    "frustration_index": frustration_index,
    "is_high_support": is_high_support,
    "is_payment_late": is_payment_late,
    "is_low_usage": is_low_usage,
    "is_new_customer": is_new_customer,
    "is_long_tenure": is_long_tenure,
    "tenure_bucket": tenure_bucket,
    "age_group": age_group,
}

V2_FEATURES = {
    "spend_per_tenure": spend_per_tenure,
    "usage_per_tenure": usage_per_tenure,
    "cost_per_usage": cost_per_usage,
    "age_tenure_ratio": age_tenure_ratio,
    "is_new_customer": is_new_customer,
    "is_long_tenure": is_long_tenure,
    "is_senior": is_senior,
    "tenure_bucket": tenure_bucket,
    "age_group": age_group,
}


def engineer_v1(df: DataFrame) -> DataFrame:
    """All fifteen derived columns of the first feature set."""
    return nan_to_null(df).withColumns({name: make() for name, make in V1_FEATURES.items()})


def engineer_v2(df: DataFrame) -> DataFrame:
    """The nine derived columns of the conservative feature set."""
    return nan_to_null(df).withColumns({name: make() for name, make in V2_FEATURES.items()})
