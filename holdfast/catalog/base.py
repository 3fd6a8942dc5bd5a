"""Shared parts of the registered queries and of their SQL twins."""

from __future__ import annotations

from holdfast.schema import NUMERIC
from holdfast.sources.tables import CUTOFF, LEDGER_NOW, LEDGER_TYPES

# Customer profile in ANSI SQL, independent of the DataFrame version.
PROFILE = f"""
returned AS (
  SELECT l_orderkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
), per_customer AS (
  SELECT o_custkey,
    min(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN o_orderdate END) AS first_before,
    max(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN o_orderdate END) AS last_before,
    sum(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 1 ELSE 0 END) AS n_before,
    sum(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority = '1-URGENT'
        THEN 1 ELSE 0 END) AS n_urgent,
    sum(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN coalesce(n_returned, 0) END) AS n_ret,
    sum(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}'
        THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS spend,
    sum(CASE WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' THEN 1 ELSE 0 END) AS n_after
  FROM orders LEFT JOIN returned ON l_orderkey = o_orderkey GROUP BY 1
), prof AS (
  SELECT c_name AS "CustomerID",
    CAST(18 + c_custkey % 63 AS INTEGER) AS "Age",
    CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS "Gender",
    CAST(floor(floor(date_diff('day', first_before, TIMESTAMP '{CUTOFF}') / 35.0)
         * (1 + c_custkey % 4) / 4.0) AS INTEGER) AS "Tenure",
    CAST(coalesce(n_before, 0) AS INTEGER) AS "Usage Frequency",
    CAST(coalesce(n_urgent, 0) AS INTEGER) AS "Support Calls",
    CAST(coalesce(n_ret, 0) AS INTEGER) AS "Payment Delay",
    CASE WHEN c_acctbal < 2500 THEN 'Basic' WHEN c_acctbal < 6000 THEN 'Standard'
         ELSE 'Premium' END AS "Subscription Type",
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Monthly'
         WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Quarterly'
         ELSE 'Annual' END AS "Contract Length",
    CAST(spend AS DOUBLE) / 1000 AS "Total Spend",
    CAST(date_diff('day', last_before, TIMESTAMP '{CUTOFF}') AS INTEGER) AS "Last Interaction",
    CASE WHEN coalesce(n_after, 0) = 0 THEN 1 ELSE 0 END AS "Churn"
  FROM customer LEFT JOIN per_customer ON o_custkey = c_custkey
)"""

SCORE = (
    'round(1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE) * ("Support Calls" - 2) '
    '+ CAST(0.05 AS DOUBLE) * ("Payment Delay" - 10) + CAST({lift} AS DOUBLE)))), 6)'
)

SCORED = f"""{PROFILE}, scored AS (
  SELECT *, "Churn" AS label, CAST(p > 0.5 AS INTEGER) AS prediction
  FROM (SELECT *, {SCORE.format(lift="0.0")} AS p FROM prof)
)"""

LIMIT = 'spend AS (SELECT quantile_cont("Total Spend", 0.2) AS q20 FROM prof)'

RULES = {
    "high_support_calls": '"Support Calls" >= 6',
    "monthly_contract": '"Contract Length" = \'Monthly\'',
    "high_payment_delay": '"Payment Delay" > 20',
    "very_low_spend": '"Total Spend" <= {limit}',
}


def rule_sql(limit: str) -> dict[str, str]:
    return {k: f"coalesce({v.format(limit=limit)}, false)" for k, v in RULES.items()}


def any_rule(limit: str) -> str:
    return "(" + " OR ".join(rule_sql(limit).values()) + ")"


def prof(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([PROFILE.strip(), *ctes]) + "\n" + body


def scored(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([SCORED.strip(), *ctes]) + "\n" + body


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


def bucket_sql(col: str, edges, labels=None) -> str:
    """Right-closed bins, lowest edge included, as a range test per bin."""
    labels = labels or [f"CAST({i} AS DOUBLE)" for i in range(len(edges) - 1)]
    parts = [f"WHEN {col} >= {edges[0]} AND {col} <= {edges[1]} THEN {labels[0]}"]
    parts += [
        f"WHEN {col} > {a} AND {col} <= {b} THEN {lab}"
        for a, b, lab in zip(edges[1:], edges[2:], labels[1:])
    ]
    return "CASE " + " ".join(parts) + " END"


def types_sql(key: str) -> str:
    listed = ", ".join(f"'{t}'" for t in LEDGER_TYPES)
    return f"list_extract([{listed}], CAST(({key}) % {len(LEDGER_TYPES)} AS INTEGER) + 1)"


NUMERIC_SQL = [f'"{c}"' for c in NUMERIC]
NOW = LEDGER_NOW

__all__ = [
    "PROFILE", "SCORED", "SCORE", "LIMIT", "RULES", "rule_sql", "any_rule", "prof", "scored",
    "union_all", "bucket_sql", "types_sql", "NUMERIC_SQL", "NOW",
]
