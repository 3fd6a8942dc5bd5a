"""Registered queries: profiling, cleaning, features (B, D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.catalog.base import (
    NUMERIC_SQL, bucket_sql, prof, any_rule, union_all, LIMIT,
)
from holdfast.functions import features as fe
from holdfast.operators import clean, profile as pr, rules, stats
from holdfast.schema import (
    AGE_EDGES, CATEGORICAL, CUSTOMER_SCHEMA, DELAY_EDGES, NUMERIC, TARGET, TENURE_EDGES,
)
from holdfast.sources.tables import customer_profile, profile_table, table

COLUMNS = CUSTOMER_SCHEMA.fieldNames()
KINDS = {"StringType": "string", "IntegerType": "int", "DoubleType": "double"}
DTYPES = {f.name: KINDS[type(f.dataType).__name__] for f in CUSTOMER_SCHEMA.fields}

Q, S = {}, {}

Q["b1_shape"] = lambda s, d: pr.shape(customer_profile(s, d))
S["b1_shape"] = prof("SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns FROM prof")

Q["b2_column_profile"] = lambda s, d: pr.column_profile(customer_profile(s, d))
S["b2_column_profile"] = prof(union_all(
    f"""SELECT '{c}' AS "column", '{DTYPES[c]}' AS dtype, count(DISTINCT "{c}") AS n_unique,
    count(*) - count("{c}") AS n_null FROM prof""" for c in COLUMNS
))

Q["b3_head"] = lambda s, d: pr.head(customer_profile(s, d), 5, ["CustomerID"])
S["b3_head"] = prof('SELECT * FROM prof ORDER BY "CustomerID" LIMIT 5')

Q["b4_describe_exact"] = lambda s, d: pr.describe_exact(profile_table(s, d), [*NUMERIC, TARGET])
S["b4_describe_exact"] = prof(union_all(
    f"""SELECT '{c}' AS "column", count("{c}") AS "count", round(avg("{c}"), 6) AS mean,
    round(stddev_samp("{c}"), 6) AS std, round(CAST(min("{c}") AS DOUBLE), 6) AS min,
    round(quantile_cont(CAST("{c}" AS DOUBLE), 0.25), 6) AS q25,
    round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 6) AS q50,
    round(quantile_cont(CAST("{c}" AS DOUBLE), 0.75), 6) AS q75,
    round(CAST(max("{c}") AS DOUBLE), 6) AS max FROM prof""" for c in [*NUMERIC, TARGET]
))

Q["b5_null_counts"] = lambda s, d: pr.null_counts(customer_profile(s, d))
S["b5_null_counts"] = prof(union_all(
    f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS n_null FROM prof""" for c in COLUMNS
))

Q["b5_null_total"] = lambda s, d: pr.null_total(customer_profile(s, d))
S["b5_null_total"] = prof(
    "SELECT CAST(" + " + ".join(f'sum(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END)' for c in COLUMNS)
    + " AS BIGINT) AS n_null FROM prof"
)


def _typed_columns(s, d):
    """How many numeric and text columns, next to the rows they were found in."""
    df = customer_profile(s, d)
    numeric, text = pr.columns_by_type(df)
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(",".join(numeric)).alias("numeric"), F.lit(",".join(text)).alias("text")
    )


Q["b6_columns_by_type"] = _typed_columns
S["b6_columns_by_type"] = prof(
    "SELECT count(*) AS n_rows, '"
    + ",".join(c for c in COLUMNS if DTYPES[c] != "string") + "' AS numeric, '"
    + ",".join(c for c in COLUMNS if DTYPES[c] == "string") + "' AS text FROM prof"
)

Q["b7_value_counts"] = lambda s, d: pr.value_counts(customer_profile(s, d), "Subscription Type")
S["b7_value_counts"] = prof(
    'SELECT "Subscription Type" AS value, count(*) AS "count" FROM prof GROUP BY 1'
)

Q["b7_value_counts_events"] = lambda s, d: pr.value_counts(table(s, d, "events"), "event_type")
S["b7_value_counts_events"] = (
    'SELECT event_type AS value, count(*) AS "count" FROM events '
    "WHERE event_type IS NOT NULL GROUP BY 1"
)

Q["b8_class_rate"] = lambda s, d: pr.class_rate(customer_profile(s, d), TARGET)
S["b8_class_rate"] = prof(
    'SELECT count("Churn") AS n, CAST(sum("Churn") AS BIGINT) AS positives, '
    'round(avg("Churn"), 6) AS rate, round(sum("Churn") * 100.0 / count(*), 6) AS pct FROM prof'
)

Q["b9_distribution"] = lambda s, d: pr.distribution(profile_table(s, d), NUMERIC)
S["b9_distribution"] = prof(union_all(
    f"""SELECT '{c}' AS "column", round(CAST(min("{c}") AS DOUBLE), 6) AS min,
    round(CAST(max("{c}") AS DOUBLE), 6) AS max, round(avg("{c}"), 6) AS mean,
    round(stddev_samp("{c}"), 6) AS std,
    round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 6) AS median,
    count(DISTINCT "{c}") AS n_unique FROM prof""" for c in NUMERIC
))


def _target_rate(s, d):
    """Find the target by name, then use it."""
    df = customer_profile(s, d)
    target = pr.find_target(df)
    return pr.value_counts(df, target).withColumn("target", F.lit(target))


Q["b10_find_target"] = _target_rate
S["b10_find_target"] = prof(
    """SELECT "Churn" AS value, count(*) AS "count", 'Churn' AS target FROM prof GROUP BY 1"""
)

BOX = ["Age", "Total Spend", "Usage Frequency", "Support Calls", "Payment Delay"]
Q["b11_box_stats"] = lambda s, d: pr.box_stats(profile_table(s, d), BOX, TARGET)
S["b11_box_stats"] = prof(union_all(
    f"""SELECT '{c}' AS "column", k AS "class", count(v) AS n, round(any_value(q1), 6) AS q1,
    round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
    round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6)
      AS whisker_low,
    round(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6)
      AS whisker_high,
    CAST(sum(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)
      AS BIGINT) AS outliers
    FROM (SELECT "Churn" AS k, CAST("{c}" AS DOUBLE) AS v FROM prof)
    JOIN (SELECT "Churn" AS k, quantile_cont(CAST("{c}" AS DOUBLE), 0.25) AS q1,
      quantile_cont(CAST("{c}" AS DOUBLE), 0.5) AS q2,
      quantile_cont(CAST("{c}" AS DOUBLE), 0.75) AS q3 FROM prof GROUP BY 1) USING (k)
    GROUP BY k""" for c in BOX
))

Q["b12_class_shares"] = lambda s, d: pr.class_shares(customer_profile(s, d), TARGET)
S["b12_class_shares"] = prof(
    'SELECT "Churn" AS value, count(*) AS "count", '
    'round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM prof GROUP BY 1'
)

Q["b13_mean_row"] = lambda s, d: pr.mean_row(customer_profile(s, d), NUMERIC)
S["b13_mean_row"] = prof(
    "SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in NUMERIC_SQL) + " FROM prof"
)

# ---- D: cleaning -----------------------------------------------------------------------------
Q["d1_drop_id"] = lambda s, d: clean.drop_id(customer_profile(s, d))
S["d1_drop_id"] = prof('SELECT * EXCLUDE ("CustomerID") FROM prof')

Q["d2_clean_v1"] = lambda s, d: clean.clean_v1(customer_profile(s, d))
S["d2_clean_v1"] = prof('SELECT * FROM prof WHERE "Churn" IS NOT NULL')

Q["d3_clean_v2"] = lambda s, d: clean.clean_v2(customer_profile(s, d))
S["d3_clean_v2"] = prof(
    "SELECT * FROM prof WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in COLUMNS)
)

Q["d3_dropped_count"] = lambda s, d: clean.dropped_count(customer_profile(s, d))
_ANY_NULL = " OR ".join(f'"{c}" IS NULL' for c in COLUMNS)
S["d3_dropped_count"] = prof(
    f"SELECT CAST(sum(CASE WHEN {_ANY_NULL} THEN 0 ELSE 1 END) AS BIGINT) AS kept, "
    f"CAST(sum(CASE WHEN {_ANY_NULL} THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM prof"
)

Q["d4_fill0"] = lambda s, d: clean.fill0(customer_profile(s, d), NUMERIC).select(
    "CustomerID", *[F.col(f"`{c}`") for c in NUMERIC]
)
S["d4_fill0"] = prof(
    'SELECT "CustomerID", ' + ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC_SQL)
    + " FROM prof"
)


def _feature_means(s, d):
    """Features and target told apart, then averaged."""
    df = customer_profile(s, d)
    clean.split_xy(df)
    numeric, _ = clean.feature_lists(df)
    return pr.mean_row(df, [*numeric, TARGET])


Q["d5_d6_feature_lists"] = _feature_means
S["d5_d6_feature_lists"] = prof(
    "SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in [*NUMERIC_SQL, '"Churn"'])
    + " FROM prof"
)

Q["d7_target_first"] = lambda s, d: clean.target_first(customer_profile(s, d))
S["d7_target_first"] = prof('SELECT "Churn", * EXCLUDE ("Churn") FROM prof')


def _partition(s, d):
    df = profile_table(s, d)
    det, amb = clean.partition_by_mask(df, rules.fit_rules(df).mask())

    def size(x, name):
        return x.agg(F.lit(name).alias("part"), F.count("*").alias("n"),
                     F.round(F.avg(TARGET), 4).alias("rate"))

    return size(det, "deterministic").unionByName(size(amb, "ambiguous"))


Q["d8_partition_by_mask"] = _partition
S["d8_partition_by_mask"] = prof(union_all([
    f"""SELECT '{name}' AS part, count(*) AS n, round(avg("Churn"), 4) AS rate
    FROM prof WHERE {neg}{any_rule("(SELECT q20 FROM spend)")}"""
    for name, neg in [("deterministic", ""), ("ambiguous", "NOT ")]
]), LIMIT)


def _ranges(s, d):
    """Class rate in low, middle and high spend of the ambiguous rows."""
    df = profile_table(s, d)
    _, amb = clean.partition_by_mask(df, rules.fit_rules(df).mask())
    parts = [
        clean.in_range(amb, "Total Spend", lo, hi).agg(
            F.lit(name).alias("band"), F.count("*").alias("count"),
            F.round(F.avg(TARGET), 4).alias("rate"),
        )
        for name, lo, hi in [("Low", 0.0, 0.25), ("Mid", 0.25, 0.75), ("High", 0.75, 1.0)]
    ]
    return clean.having_min(stats.union_results(parts), 10)


Q["d9_d10_in_range"] = _ranges
S["d9_d10_in_range"] = prof(union_all([
    f"""SELECT '{name}' AS band, count(*) AS "count", round(avg("Churn"), 4) AS rate FROM amb
    WHERE "Total Spend" >= (SELECT quantile_cont("Total Spend", {lo}) FROM amb)
      AND "Total Spend" < (SELECT quantile_cont("Total Spend", {hi}) FROM amb)
    HAVING count(*) > 10"""
    for name, lo, hi in [("Low", 0.0, 0.25), ("Mid", 0.25, 0.75), ("High", 0.75, 1.0)]
]), LIMIT, f'amb AS (SELECT * FROM prof WHERE NOT {any_rule("(SELECT q20 FROM spend)")})')

_PAIRS = [(a, b) for a in NUMERIC for b in NUMERIC if a != b]


def _high_corr(s, d):
    matrix = stats.corr_matrix(customer_profile(s, d), NUMERIC)
    return clean.high_corr(matrix.filter("feature_a <> feature_b"), 0.5)


Q["d11_high_corr"] = _high_corr
S["d11_high_corr"] = prof("SELECT * FROM (" + union_all(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr("{a}", "{b}"), 6) AS corr
    FROM prof""" for a, b in _PAIRS
) + ") WHERE abs(corr) > 0.5")


def _conversions(s, d):
    """Percent, hour and minute conversions over all line items."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(s, d, "lineitem").agg(
        F.round(F.avg(F.col("l_discount") * 100.0), 4).alias("discount_pct"),
        F.round(F.avg(days * 24.0), 2).alias("hours"),
        F.round(F.avg(days * 24.0) * 60.0, 1).alias("minutes"),
    )


Q["d12_conversions"] = _conversions
S["d12_conversions"] = (
    "SELECT round(avg(l_discount * 100.0), 4) AS discount_pct, "
    "round(avg(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) * CAST(24.0 AS DOUBLE)), 2) "
    "AS hours, round(avg(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) "
    "* CAST(24.0 AS DOUBLE)) * 60.0, 1) AS minutes FROM lineitem"
)

# ---- E: features -----------------------------------------------------------------------------
_T1 = '("Tenure" + 1)'
_U1 = '("Usage Frequency" + 1)'


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


FEATURE_SQL = {
    "spend_per_tenure": f'"Total Spend" / {_T1}',
    "support_per_tenure": f'CAST("Support Calls" AS DOUBLE) / {_T1}',
    "usage_per_tenure": f'CAST("Usage Frequency" AS DOUBLE) / {_T1}',
    "delay_per_tenure": f'CAST("Payment Delay" AS DOUBLE) / {_T1}',
    "cost_per_usage": f'"Total Spend" / {_U1}',
    "recency_score": '"Last Interaction" / CAST(30.0 AS DOUBLE)',
    "risk_score": '"Support Calls" * "Payment Delay"',
    "frustration_index": f'CAST("Support Calls" AS DOUBLE) / {_U1}',
    "is_high_support": _flag('"Support Calls" >= 7'),
    "is_payment_late": _flag('"Payment Delay" >= 15'),
    "is_low_usage": _flag('"Usage Frequency" <= 5'),
    "is_new_customer": _flag('"Tenure" <= 6'),
    "is_long_tenure": _flag('"Tenure" >= 40'),
    "is_senior": _flag('"Age" >= 50'),
    "age_tenure_ratio": f'CAST("Age" AS DOUBLE) / {_T1}',
    "tenure_bucket": bucket_sql('"Tenure"', TENURE_EDGES),
    "age_group": bucket_sql('"Age"', AGE_EDGES),
}
_ORDER = [
    "spend_per_tenure", "support_per_tenure", "usage_per_tenure", "delay_per_tenure",
    "cost_per_usage", "recency_score", "risk_score", "frustration_index", "is_high_support",
    "is_payment_late", "is_low_usage", "is_new_customer", "is_long_tenure", "is_senior",
    "age_tenure_ratio", "tenure_bucket", "age_group",
]


def _one_feature(name):
    make = {**fe.V1_FEATURES, **fe.V2_FEATURES}[name]
    return lambda s, d: customer_profile(s, d).select("CustomerID", make().alias(name))


for _i, _name in enumerate(_ORDER, 1):
    Q[f"e{_i}_{_name}"] = _one_feature(_name)
    S[f"e{_i}_{_name}"] = prof(
        f'SELECT "CustomerID", {FEATURE_SQL[_name]} AS {_name} FROM prof'
    )

Q["e18_cut"] = lambda s, d: customer_profile(s, d).select(
    "CustomerID", fe.cut("Payment Delay", DELAY_EDGES).alias("delay_bin")
)
S["e18_cut"] = prof(
    f'SELECT "CustomerID", {bucket_sql(chr(34) + "Payment Delay" + chr(34), DELAY_EDGES)} '
    "AS delay_bin FROM prof"
)

QLABELS = ["Q1(low)", "Q2", "Q3", "Q4", "Q5(high)"]
Q["e19_qcut"] = lambda s, d: stats.qcut(
    profile_table(s, d), "Total Spend", 5, QLABELS
).select("CustomerID", "qbin")
_EDGES = "edges AS (SELECT " + ", ".join(
    f'quantile_cont("Total Spend", {i / 5}) AS e{i}' for i in range(6)
) + " FROM prof)"
QCUT_SQL = bucket_sql('"Total Spend"', [f"e{i}" for i in range(6)], [f"'{x}'" for x in QLABELS])
S["e19_qcut"] = prof(f'SELECT "CustomerID", {QCUT_SQL} AS qbin FROM prof, edges', _EDGES)

Q["e20_engineer_v1"] = lambda s, d: fe.engineer_v1(customer_profile(s, d))
S["e20_engineer_v1"] = prof(
    "SELECT *, " + ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in fe.V1_FEATURES) + " FROM prof"
)
Q["e20_engineer_v2"] = lambda s, d: fe.engineer_v2(customer_profile(s, d))
S["e20_engineer_v2"] = prof(
    "SELECT *, " + ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in fe.V2_FEATURES) + " FROM prof"
)

QUERIES, ORACLES = Q, S
EDGES_CTE = _EDGES
__all__ = ["QUERIES", "ORACLES", "QCUT_SQL", "EDGES_CTE", "FEATURE_SQL", "CATEGORICAL"]
