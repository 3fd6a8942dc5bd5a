"""Registered queries: explanations (N), cost (O), requests and sinks (A), scalars (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.catalog.base import (
    LIMIT, NOW, any_rule, prof, scored, types_sql, union_all,
)
from holdfast.catalog.insight import (
    ACC, AUC, CM, F1, POINTS, PREC, REC,
    COEF, CONTRIB, IMPORTANCE, MODELS, contributions, hybrid, HYBRID, importance_of,
)
from holdfast.catalog.quality import CHECKS, ENDPOINTS, PRICES, REPORT_PARTS
from holdfast.functions import features as fe, scalars as sc
from holdfast.operators import cost, explain, metrics, rules, stats
from holdfast.plans import results as res
from holdfast.schema import CUSTOMER_SCHEMA, NUMERIC, OVERSIZED, TARGET, TUNING_PRICE
from holdfast.sources import readers as rd, sinks as sk, tables as tb

Q, S = {}, {}
COLUMNS = CUSTOMER_SCHEMA.fieldNames()

# ---- N: explanations -------------------------------------------------------------------------
Q["n6_explain_global"] = lambda s, d: explain.explain_global(contributions(s, d)[0])
S["n6_explain_global"] = prof("""SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap,
  round(avg(shap), 6) + 0.0 AS mean_shap, round(stddev_pop(shap), 6) AS std_shap FROM contrib
  GROUP BY 1""", CONTRIB)


def _linear(s, d):
    long, means = contributions(s, d)
    base = explain.linear_base(COEF, 0.25, means)
    return long.groupBy("row_id").agg(
        F.round(F.lit(base), 6).alias("base"), F.round(F.sum("shap") + base, 6).alias("output")
    )


_LINEAR_MEANS = " + ".join(
    f'CAST({w} AS DOUBLE) * (SELECT round(avg("{c}"), 6) FROM clean)' for c, w in COEF.items()
)
_LINEAR = " + ".join(f'CAST({w} AS DOUBLE) * "{c}"' for c, w in COEF.items())
Q["n7_shap_linear"] = lambda s, d: contributions(s, d)[0].withColumn("shap", F.round("shap", 9))
S["n7_shap_linear"] = prof("SELECT * REPLACE (round(shap, 9) AS shap) FROM contrib", CONTRIB)
Q["n7_shap_additivity"] = _linear
S["n7_shap_additivity"] = prof(f"""SELECT "CustomerID" AS row_id,
  round(0.25 + {_LINEAR_MEANS}, 6) AS base, round(0.25 + {_LINEAR}, 6) + 0.0 AS output
  FROM clean""",
                               CONTRIB)

_NORM = (
    'scored AS (SELECT "CustomerID" AS row_id, 1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE) * '
    '("Support Calls" - 2) + CAST(0.05 AS DOUBLE) * ("Payment Delay" - 10)))) AS p FROM clean)'
)
_SHOWN = """shown AS (SELECT row_id,
    string_agg('  • ' || feature || ': ' || printf('%.2f', value) || ' (impact: +'
      || printf('%.3f', shap) || ')' || chr(10), '' ORDER BY rank)
      FILTER (direction = 'positive') AS up,
    string_agg('  • ' || feature || ': ' || printf('%.2f', value) || ' (impact: '
      || printf('%.3f', shap) || ')' || chr(10), '' ORDER BY rank)
      FILTER (direction = 'negative') AS down FROM top GROUP BY 1)"""
_TOP3 = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, direction
  ORDER BY abs(shap) DESC, feature) AS rank FROM (SELECT *, CASE WHEN shap > 0 THEN 'positive'
  ELSE 'negative' END AS direction FROM contrib WHERE shap <> 0)) WHERE rank <= 3)"""


def _explained(s, d):
    """Row explanations with the closed-form score in the place of a model."""
    df = tb.profile_table(s, d).dropna()
    p = tb.closed_form_score(digits=None)
    means = {c: round(m, 6) for c, m in explain.background_means(df, list(COEF)).items()}
    out = explain.explain_rows(
        df.withColumns({"p": p, "prediction": p > 0.5}), explain.linear_entries(COEF, means),
        explain.linear_base(COEF, 0.25, means), "CustomerID",
    )
    return out.select(
        "row_id", "prediction", F.round("probability.no_churn", 6).alias("no_churn"),
        F.round("probability.churn", 6).alias("churn"), F.round("base_value", 6).alias("base_value"),
        F.size("churn_factors").alias("n_up"), F.size("retention_factors").alias("n_down"),
        "explanation_text",
    )


Q["n9_n10_explain_rows"] = _explained
S["n9_n10_explain_rows"] = prof(f"""SELECT row_id, CAST(p > 0.5 AS INTEGER) AS prediction,
  round(1.0 - p, 6) AS no_churn, round(p, 6) AS churn,
  round(0.25 + {_LINEAR_MEANS}, 6) AS base_value,
  CAST((SELECT count(*) FROM contrib c WHERE c.row_id = scored.row_id AND shap > 0) AS INTEGER)
    AS n_up,
  CAST((SELECT count(*) FROM contrib c WHERE c.row_id = scored.row_id AND shap < 0) AS INTEGER)
    AS n_down,
  CASE WHEN p > 0.5 THEN 'This customer is likely to churn (confidence: '
      || printf('%.1f', p * 100.0) || '%).' || chr(10) || chr(10)
      || 'Key factors increasing churn risk:' || chr(10) || coalesce(up, '') || chr(10)
      || 'Factors helping retention:' || chr(10) || coalesce(down, '')
    ELSE 'This customer is likely to stay (confidence: '
      || printf('%.1f', (1.0 - p) * 100.0) || '%).' || chr(10) || chr(10)
      || 'Key factors supporting retention:' || chr(10) || coalesce(down, '') || chr(10)
      || 'Potential churn risk factors to monitor:' || chr(10) || coalesce(up, '') END
    AS explanation_text FROM scored LEFT JOIN shown USING (row_id)""",
                               CONTRIB, _NORM, _TOP3, _SHOWN)

ENGINEERED = [*[c for c in COLUMNS if c not in ("CustomerID", TARGET)], *fe.V2_FEATURES]


def _approx(s, d):
    """Value times importance, the five strongest of either sign, and the sentence."""
    df = fe.engineer_v2(tb.profile_table(s, d).dropna())
    p = tb.closed_form_score(digits=None)
    entries = explain.approx_entries(df, importance_of(df), ENGINEERED)
    rows = explain.with_factors(
        df.withColumns({"p": p, "prediction": (p > 0.5).cast("int")}), entries, 5,
        zero_is_negative=True,
    )
    return explain.approx_text(rows).select(
        F.col("CustomerID").alias("row_id"), F.size("churn_factors").alias("n_up"),
        F.size("retention_factors").alias("n_down"),
        F.round(F.get("churn_factors", F.lit(0))["impact"], 6).alias("strongest"),
        "explanation_text",
    )


def _approx_long(s, d):
    """N11 as a long table: value, importance (0.01 when unknown) and contribution."""
    df = fe.engineer_v2(tb.profile_table(s, d).dropna())
    long = explain.approx_contributions(df, importance_of(df), "CustomerID", ENGINEERED)
    return long.groupBy("feature").agg(
        F.count("*").alias("n"), F.round(F.sum("contribution"), 5).alias("total")
    )


def _engineered_sql():
    from holdfast.catalog.exploration import FEATURE_SQL
    text = {"Gender", "Subscription Type", "Contract Length"}
    parts = []
    for c in ENGINEERED:
        value = "0" if c in text else f"coalesce({FEATURE_SQL.get(c, chr(34) + c + chr(34))}, 0)"
        parts.append(f"""SELECT "CustomerID" AS row_id, '{c}' AS feature,
          CAST({value} AS DOUBLE) AS value FROM clean""")
    return "long AS (" + union_all(parts) + ")"


Q["n11_approx_contributions"] = _approx
S["n11_approx_contributions"] = prof(
    """SELECT row_id, CAST(count(*) FILTER (direction = 'positive') AS INTEGER) AS n_up,
      CAST(count(*) FILTER (direction = 'negative') AS INTEGER) AS n_down,
      round(max(contribution) FILTER (direction = 'positive' AND rank = 1), 6) AS strongest,
      CASE WHEN any_value(p) > 0.5 THEN 'This customer has a ' || printf('%.1f', any_value(p)
        * 100.0) || '% probability of churning (ML model prediction). Main risk factors: '
        || coalesce(string_agg(feature, ', ' ORDER BY rank)
           FILTER (direction = 'positive' AND rank <= 3), '')
      ELSE 'This customer is likely to stay (retention: ' || printf('%.1f', (1.0 - any_value(p))
        * 100.0) || '%). Positive factors: ' || coalesce(string_agg(feature, ', ' ORDER BY rank)
           FILTER (direction = 'negative' AND rank <= 3), '') END AS explanation_text
    FROM ranked JOIN scored USING (row_id) WHERE rank <= 5 GROUP BY 1""",
    CONTRIB.split(", contrib AS")[0], _NORM, _engineered_sql(),
    IMPORTANCE.replace("FROM prof", "FROM clean"),
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, direction
      ORDER BY abs(contribution) DESC, feature) AS rank FROM (
        SELECT row_id, long.feature, value * coalesce(importance, 0.01) AS contribution,
          CASE WHEN value * coalesce(importance, 0.01) > 0 THEN 'positive' ELSE 'negative' END
          AS direction FROM long LEFT JOIN importance ON long.feature = importance.feature))""",
)


Q["n11_approx_long"] = _approx_long
S["n11_approx_long"] = prof(
    """SELECT feature, count(*) AS n, round(sum(CASE WHEN feature = 'tenure_bucket' AND gone THEN
      NULL ELSE value END * coalesce(importance, 0.01)), 5) AS total
      FROM (SELECT long.*, importance, clean."Tenure" > 61 AS gone FROM long
        LEFT JOIN importance USING (feature) JOIN clean ON clean."CustomerID" = row_id) GROUP BY 1""",
    CONTRIB.split(", contrib AS")[0], _engineered_sql(),
    IMPORTANCE.replace("FROM prof", "FROM clean"),
)


def _info(s, d):
    df = tb.profile_table(s, d)
    fitted = rules.churn_rules(2000.0)
    return res.model_info(
        fitted, rules.rule_analysis(df, fitted), stats.subset_report(df, ~fitted.mask(), TARGET),
        "ClosedForm",
    )


_SURE = "→ 100% churn in training data"
Q["n15_model_info"] = _info
S["n15_model_info"] = prof(f"""SELECT 'hybrid' AS approach,
  'Rules Engine for deterministic cases + ML Model for ambiguous cases' AS description,
  'Support Calls >= 6 {_SURE}; Monthly contract {_SURE}; Payment Delay > 20 {_SURE}; '
    || 'Total Spend <= 2000.0 {_SURE}' AS rules,
  printf('%.1f', round(count(*) FILTER ({any_rule("2000.0")}) * CAST(100.0 AS DOUBLE)
    / count(*), 1)) || '% of training data' AS coverage,
  true AS loaded, 'ClosedForm' AS model_type,
  count(*) FILTER (NOT {any_rule("2000.0")}) || ' ambiguous rows ('
    || printf('%.1f', round(avg("Churn") FILTER (NOT {any_rule("2000.0")}), 4) * 100.0)
    || '% churn rate)' AS trained_on, '100% (by definition — deterministic patterns)' AS precision,
  '3.0.0' AS version, CAST(NULL AS VARCHAR) AS training_metrics FROM prof""")


def _card(s, d):
    """Every line of the model card."""
    bundle = metrics.metric_bundle(tb.scored_profile(s, d), digits=4)
    ranking = explain.explain_global(contributions(s, d)[0], 4)
    return res.model_card(bundle, ranking, "ClosedForm", len(COEF), NOW)


def _texts(lines):
    return "[" + ", ".join(f"'{x}'" for x in lines) + "]"


# Wording of the card.
_CARD_HEAD = ["# Model Card: Customer Churn Prediction", "", "## Model Details",
              "- **Model Type**: ClosedForm", "- **Version**: 2.0",
              f"- **Training Date**: {NOW[:10]}", "- **Framework**: Spark ML", "",
              "## Intended Use", "- **Primary Use**: Predict customer churn probability",
              "- **Users**: Customer Success teams, Marketing",
              "- **Out-of-scope**: Credit decisions, automated service termination", "",
              "## Training Data", "- **Source**: Customer behavior and demographic data",
              "- **Size**: Specified at training time",
              f"- **Features**: {len(COEF)} features after preprocessing", "",
              "## Performance Metrics"]
_CARD_TAIL = ["", "## Ethical Considerations",
              "- Model does not use protected attributes (race, religion, etc.)",
              "- Gender is used as a feature - monitor for disparate impact",
              "- Regular fairness audits recommended", "", "## Limitations",
              "- Performance may degrade with distribution shift",
              "- Requires retraining with new customer segments",
              "- Not suitable for real-time high-frequency predictions", "",
              "## Monitoring Recommendations", "- Track prediction distribution weekly",
              "- Alert on >10% drift in feature distributions",
              "- Quarterly model performance review", "", "---", f"Generated: {NOW}"]
_CARD_METRICS = {"Accuracy": ACC, "ROC-AUC": AUC, "Precision": PREC, "Recall": REC, "F1-Score": F1}
Q["n14_model_card"] = _card
S["n14_model_card"] = scored(
    f"""SELECT CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS text FROM (
      SELECT {_texts(_CARD_HEAD)} || ["""
    + ", ".join(f"'- **{n}**: ' || round({e}, 4)" for n, e in _CARD_METRICS.items())
    + f"""] || ['', '## Feature Importance (Top 5)'] || (SELECT list(t ORDER BY o) FROM (
        SELECT row_number() OVER (ORDER BY m DESC, feature) AS o, row_number() OVER (
          ORDER BY m DESC, feature) || '. **' || feature || '**: ' || printf('%.4f', m) AS t
        FROM (SELECT feature, round(avg(abs(shap)), 4) AS m FROM contrib GROUP BY 1)) WHERE o <= 5)
      || {_texts(_CARD_TAIL)} AS l FROM cm)""", CM, POINTS, CONTRIB,
)

# ---- O: cost ---------------------------------------------------------------------------------
def _endpoints(s, d):
    return cost.endpoint_costs(
        tb.ledger_endpoints(s, d), tb.ledger_configs(s, d), tb.price_table(s), NOW
    )


ENDPOINT_COSTS = f"""{ENDPOINTS}, {PRICES}, hourly AS (
  SELECT k, sum(CASE WHEN position IS NULL THEN 0 ELSE coalesce(hourly, 0.1) * instance_count END)
      AS h, any_value(v.instance_type) FILTER (position = 0) AS t,
    any_value(instance_count) FILTER (position = 0) AS c
  FROM variants v LEFT JOIN prices p ON v.instance_type = p.instance_type GROUP BY 1
), ep AS (
  SELECT name AS endpoint_name, status, created_at, coalesce(t, 'unknown') AS instance_type,
    coalesce(c, 1) AS instance_count, round(CAST(h AS DOUBLE), 4) AS hourly_cost_usd,
    round(hours, 2) AS runtime_hours, round(h * hours, 2) AS total_cost_usd
  FROM (SELECT *, coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at), 0)
      / CAST(1000000.0 AS DOUBLE) / CAST(3600.0 AS DOUBLE) AS hours FROM endpoints
      JOIN hourly USING (k) WHERE status = 'InService')
)"""
Q["o1_endpoint_costs"] = lambda s, d: _endpoints(s, d)
S["o1_endpoint_costs"] = f"WITH {ENDPOINT_COSTS} SELECT * FROM ep"

JOBS = f"""jobs AS (SELECT *, CASE WHEN status <> 'InProgress' THEN started
    + to_milliseconds((o_orderkey % 7200 + 30) * 1000 + 7) END AS ended FROM (
  SELECT o_orderkey, 'job-' || o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'Completed'
      WHEN 'O' THEN 'InProgress' ELSE 'Stopped' END AS status,
    {types_sql("o_orderkey")} AS instance_type,
    CAST(1 + o_orderkey % 2 AS INTEGER) AS instance_count, o_orderdate AS created,
    o_orderdate + to_minutes(o_orderkey % 60) AS started,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000000.0 END AS objective FROM orders)
), jc AS (
  SELECT job, status, j.instance_type, instance_count, round(hours * 60.0, 2) AS duration_minutes,
    coalesce(hourly, 0.115) AS hourly_rate_usd,
    round(coalesce(hourly, 0.115) * instance_count * hours, 4) AS total_cost_usd, created
  FROM (SELECT *, coalesce(epoch_us(ended) - epoch_us(started), 0) / CAST(1000000.0 AS DOUBLE)
    / CAST(3600.0 AS DOUBLE) AS hours FROM jobs) j
  LEFT JOIN prices ON j.instance_type = prices.instance_type
)"""


def _jobs(s, d):
    return cost.job_costs(tb.ledger_jobs(s, d), tb.price_table(s))


Q["o2_job_costs"] = _jobs
S["o2_job_costs"] = f"WITH {PRICES}, {JOBS} SELECT * FROM jc"

Q["o3_cost_summary"] = lambda s, d: cost.cost_summary(_endpoints(s, d), _jobs(s, d), NOW, 30)
SUMMARY = f"""rj AS (SELECT * FROM jc WHERE created > TIMESTAMP '{NOW}' - INTERVAL 30 DAYS
), summary AS (SELECT 30 AS period_days, count(*) AS active_endpoints,
    round(e, 2) AS endpoint_total_usd, round(h, 4) AS hourly_rate_usd,
    round(h * 24, 2) AS daily_rate_usd, round(h * 24 * 30, 2) AS monthly_projection_usd,
    (SELECT count(*) FROM rj) AS jobs_count, round(t, 2) AS training_total_usd,
    round(e + t, 2) AS total_cost_usd, (SELECT string_agg(job, ',' ORDER BY created DESC, job DESC)
      FROM (SELECT * FROM rj ORDER BY created DESC, job LIMIT 5)) AS recent_jobs
  FROM ep, (SELECT CAST(coalesce(sum(CAST(total_cost_usd AS DECIMAL(20,4))), 0) AS DOUBLE) AS e,
      CAST(coalesce(sum(CAST(hourly_cost_usd AS DECIMAL(20,4))), 0) AS DOUBLE) AS h FROM ep),
    (SELECT CAST(coalesce(sum(CAST(total_cost_usd AS DECIMAL(20,4))), 0) AS DOUBLE) AS t FROM rj)
  GROUP BY e, h, t)"""
S["o3_cost_summary"] = f"WITH {ENDPOINT_COSTS}, {JOBS}, {SUMMARY} SELECT * FROM summary"

Q["o4_cost_recommendations"] = lambda s, d: cost.cost_recommendations(_endpoints(s, d))
_BIG = ", ".join(f"'{t}'" for t in OVERSIZED)
RECOMMEND = f"""rec AS (SELECT 'warning' AS type, endpoint_name AS resource,
    'Endpoint running for ' || round(CAST(runtime_hours AS DECIMAL(18,2)), 1) || ' hours'
      AS issue,
    'Delete endpoint when not in use to save costs' AS recommendation,
    round(hourly_cost_usd * 24 * 30, 2) AS savings_usd, NULL AS savings_note
  FROM ep WHERE runtime_hours > 24
  UNION ALL SELECT 'optimization', endpoint_name, 'Using ' || instance_type
    || ' which may be oversized',
    'Consider ml.t2.medium or ml.t3.medium for low-traffic endpoints',
    round((hourly_cost_usd - 0.05) * 24 * 30, 2), NULL FROM ep WHERE instance_type IN ({_BIG})
  UNION ALL SELECT 'best_practice', 'all', 'General cost optimization',
    'Use batch transform for batch predictions instead of real-time endpoints', NULL,
    'Variable based on usage pattern'
  UNION ALL SELECT 'best_practice', 'all', 'Development best practice',
    'Always delete endpoints after testing. Use: delete_endpoint()', NULL,
    'Up to $40/month per endpoint')"""
S["o4_cost_recommendations"] = f"WITH {ENDPOINT_COSTS}, {RECOMMEND} SELECT * FROM rec"

Q["o5_idle_endpoints"] = lambda s, d: cost.idle_endpoints(_endpoints(s, d), 24).select(
    "endpoint_name", "runtime_hours", "total_cost_usd"
)
S["o5_idle_endpoints"] = f"""WITH {ENDPOINT_COSTS} SELECT endpoint_name, runtime_hours,
  total_cost_usd FROM ep WHERE runtime_hours > 24"""


def _plans(s, d):
    """One tuning plan per instance type found in the job ledger."""
    return tb.ledger_jobs(s, d).groupBy("instance_type").agg(
        F.count("*").alias("max_jobs"), F.lit(5).alias("minutes")
    )


Q["o6_tuning_cost"] = lambda s, d: cost.tuning_cost(_plans(s, d), tb.price_table(s, TUNING_PRICE))
S["o6_tuning_cost"] = f"""WITH tp AS (SELECT * FROM (VALUES {", ".join(
    f"('{k}', CAST({v} AS DOUBLE))" for k, v in TUNING_PRICE.items()
)}) t(instance_type, hourly)), plans AS (SELECT {types_sql("o_orderkey")} AS instance_type,
  count(*) AS max_jobs, 5 AS minutes FROM orders GROUP BY 1)
  SELECT plans.*, coalesce(hourly, 0.115) AS hourly_rate,
    round(max_jobs * coalesce(hourly, 0.115) * (minutes / CAST(60.0 AS DOUBLE)), 2) AS max_cost_usd,
    round(max_jobs * coalesce(hourly, 0.115) * (minutes / CAST(60.0 AS DOUBLE)) * 0.7, 2)
      AS typical_cost_usd FROM plans LEFT JOIN tp USING (instance_type)"""


def _cost_report(s, d):
    ep = _endpoints(s, d)
    return cost.cost_report(
        cost.cost_summary(ep, _jobs(s, d), NOW, 7), cost.cost_recommendations(ep)
    )


Q["o7_cost_report"] = _cost_report
S["o7_cost_report"] = f"""WITH {ENDPOINT_COSTS}, {JOBS}, {SUMMARY.replace("INTERVAL 30 DAYS",
    "INTERVAL 7 DAYS").replace("30 AS period_days", "7 AS period_days")}, {RECOMMEND},
  head AS (SELECT ['COST REPORT', 'Summary (Last 7 days)', 'Active Endpoints: ' || active_endpoints,
    'Training Jobs: ' || jobs_count, 'Total Cost: $' || printf('%.2f', total_cost_usd),
    'Endpoint Costs', 'Current Total: $' || printf('%.2f', endpoint_total_usd),
    'Hourly Rate: $' || printf('%.4f', hourly_rate_usd),
    'Daily Rate: $' || printf('%.2f', daily_rate_usd),
    'Monthly Projection: $' || printf('%.2f', monthly_projection_usd), 'Training Costs',
    'Jobs Count: ' || jobs_count, 'Total: $' || printf('%.2f', training_total_usd),
    'Recommendations'] AS l FROM summary)
  SELECT CAST(unnest(range(14)) AS INTEGER) AS line, unnest(l) AS text FROM head
  UNION ALL SELECT CAST(13 + row_number() OVER (ORDER BY type <> 'best_practice' DESC, resource,
      type DESC, issue) AS INTEGER), '[' || upper(type) || '] ' || recommendation
      || coalesce('   Potential savings: $' || printf('%.2f', savings_usd) || '/month', '')
  FROM (SELECT * FROM rec ORDER BY type <> 'best_practice' DESC, resource, type DESC, issue LIMIT 5)
"""


def _tuning(s, d):
    from holdfast.plans.tuning import tuning_summary
    return tuning_summary(tb.ledger_jobs(s, d).withColumn(
        "params", F.format_string('{"max_depth": %d}', (F.col("instance_count") + 3).cast("int"))
    ))


Q["l14_tuning_summary"] = _tuning
S["l14_tuning_summary"] = f"""WITH {PRICES}, {JOBS} SELECT count(*) AS total_jobs,
  count(*) FILTER (status = 'Completed') AS completed_jobs,
  (SELECT job FROM jobs WHERE objective IS NOT NULL ORDER BY objective DESC, job LIMIT 1)
    AS best_job,
  (SELECT '{{"max_depth": ' || (instance_count + 3) || '}}' FROM jobs WHERE objective IS NOT NULL
    ORDER BY objective DESC, job LIMIT 1) AS best_params,
  max(objective) AS best_objective FROM jobs"""


# ---- A: requests and sinks -------------------------------------------------------------------
REQUEST = "Age INT, Tenure INT, `Support Calls` INT, `Total Spend` DOUBLE, Gender STRING"


def _bodies(s, d):
    """JSON requests made from the profile: objects, arrays, scalars, broken text."""
    df = tb.customer_profile(s, d)
    one = F.to_json(F.struct(
        "Age", "Tenure", "Support Calls", "Total Spend", "Gender"
    ))
    kind = F.col("Age") % 5
    return df.select(
        "CustomerID",
        F.when(kind == 0, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .when(kind == 1, F.lit("17")).when(kind == 2, F.lit('{"Age": '))
        .when(kind == 3, F.lit("[]")).otherwise(one).alias("body"),
    )


Q["a4_parse_json_rows"] = lambda s, d: rd.parse_json_rows(_bodies(s, d), "body", REQUEST).select(
    "CustomerID", "position", "error", "Age", "Tenure", "Support Calls", "Total Spend", "Gender"
)
S["a4_parse_json_rows"] = prof("""SELECT "CustomerID", position, error,
    CASE WHEN error IS NULL THEN "Age" END AS "Age",
    CASE WHEN error IS NULL THEN "Tenure" END AS "Tenure",
    CASE WHEN error IS NULL THEN "Support Calls" END AS "Support Calls",
    CASE WHEN error IS NULL THEN "Total Spend" END AS "Total Spend",
    CASE WHEN error IS NULL THEN "Gender" END AS "Gender"
  FROM (SELECT prof.*, i AS position, CASE WHEN "Age" % 5 IN (1, 2)
      THEN 'body must be an object or an array of objects' END AS error
    FROM prof JOIN (VALUES (0), (1)) t(i) ON (i = 0 AND "Age" % 5 <> 3) OR "Age" % 5 = 0)""")


def _csv_rows(s, d):
    df = tb.customer_profile(s, d)
    text = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in NUMERIC])
    schema = ", ".join(f"c{i} DOUBLE" for i in range(len(NUMERIC)))
    return rd.parse_csv_rows(
        df.dropna().select("CustomerID", text.alias("line")), "line", schema
    ).drop("line")


Q["a3_parse_csv_rows"] = _csv_rows
S["a3_parse_csv_rows"] = prof('SELECT "CustomerID", ' + ", ".join(
    f'CAST("{c}" AS DOUBLE) AS c{i}' for i, c in enumerate(NUMERIC)
) + " FROM prof WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in NUMERIC))

Q["a12_to_json_response"] = lambda s, d: sk.to_json_response(
    hybrid(s, d).select("CustomerID", "churn_prediction", "risk_level", "prediction_source"),
    "CustomerID",
)
S["a12_to_json_response"] = prof("""SELECT "CustomerID", '{"churn_prediction":' || churn_prediction
  || ',"risk_level":"' || risk_level || '","prediction_source":"' || prediction_source || '"}'
  AS response FROM hybrid""", LIMIT, HYBRID)


def _run_log(s, d):
    """Every scorer logs its metrics and parameter, then the log is read back."""
    path = sk.fresh_path(s, "runs")
    df = tb.profile_table(s, d)
    for m, lift in MODELS.items():
        rows = df.select(F.col(TARGET).alias("label"), tb.closed_form_score(lift=lift).alias("p"))
        found = rows.agg(
            F.round(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int")), 6)
            .alias("accuracy"),
            F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier_score"),
        )
        sk.log_run(res.run_rows(found, "compare", m, {"lift": lift}), path)
    return s.read.parquet(path).select("experiment", "run_id", "kind", "key", "value")


Q["a11_log_run"] = _run_log
S["a11_log_run"] = prof(union_all(
    f"""SELECT 'compare' AS experiment, '{m}' AS run_id, kind, key, value FROM (
      SELECT 'metric' AS kind, 'accuracy' AS key, CAST(round(avg(CASE WHEN (p > 0.5) = (label = 1)
        THEN 1 ELSE 0 END), 6) AS VARCHAR) AS value FROM s_{m}
      UNION ALL SELECT 'metric', 'brier_score', CAST(round(avg(power(p - label, 2)), 6) AS VARCHAR)
        FROM s_{m} UNION ALL SELECT 'param', 'lift', '{lift}')"""
    for m, lift in MODELS.items()
), *[
    f"""s_{m} AS (SELECT "Churn" AS label, round(1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE) *
    ("Support Calls" - 2) + CAST(0.05 AS DOUBLE) * ("Payment Delay" - 10)
    + CAST({lift} AS DOUBLE)))), 6) AS p FROM prof)""" for m, lift in MODELS.items()
])


def _round_trip(write, read):
    """Write the profile, read it back: the rows must survive."""
    def run(s, d):
        path = sk.fresh_path(s, "profile")
        write(tb.customer_profile(s, d), path)
        return read(s, path)
    return run


Q["a1_a5_csv_round_trip"] = _round_trip(sk.write_processed, rd.read_customers)
S["a1_a5_csv_round_trip"] = prof("SELECT * FROM prof")

_TARGET_FIRST = [TARGET, *[c for c in COLUMNS if c != TARGET]]
Q["a6_target_first_round_trip"] = _round_trip(
    lambda df, path: sk.write_target_first(df, TARGET, path),
    lambda s, path: rd.read_positional(s, path, ", ".join(
        f"`{c}` {CUSTOMER_SCHEMA[c].dataType.simpleString()}" for c in _TARGET_FIRST
    )),
)
S["a6_target_first_round_trip"] = prof("SELECT * FROM prof")


def _clean_copy(s, d):
    path = sk.fresh_path(s, "clean")
    for _ in range(2):                     # the second call finds the copy and leaves it alone
        sk.materialize_clean(tb.customer_profile(s, d), path)
    return s.read.schema(CUSTOMER_SCHEMA).parquet(path)


Q["a7_materialize_clean"] = _clean_copy
S["a7_materialize_clean"] = prof(
    "SELECT * FROM prof WHERE " + " AND ".join(f'"{c}" IS NOT NULL' for c in COLUMNS)
)


def _importance_file(s, d):
    path = sk.fresh_path(s, "importance")
    sk.write_importance(importance_of(tb.customer_profile(s, d)), path)
    return rd.read_importance(s, path)


Q["a9_importance_round_trip"] = _importance_file
S["a9_importance_round_trip"] = prof("SELECT * FROM importance", IMPORTANCE)


def _report_file(s, d):
    path = sk.fresh_path(s, "report")
    df = tb.customer_profile(s, d)
    sk.write_report(df.agg(F.struct(
        F.count("*").alias("total_rows"), F.round(F.avg(TARGET), 4).alias("churn_rate"),
    ).alias("dataset")), path)
    return s.read.schema("dataset struct<total_rows: bigint, churn_rate: double>").json(path).select(
        "dataset.*"
    )


Q["a8_write_report"] = _report_file
S["a8_write_report"] = prof(
    'SELECT count(*) AS total_rows, round(avg("Churn"), 4) AS churn_rate FROM prof'
)


def _validated_file(s, d):
    """C11: validate a written CSV file; the verdict beside every line of the report."""
    path = sk.fresh_path(s, "to-validate")
    sk.write_processed(tb.customer_profile(s, d), path)
    passed, text = rd.validate_path(s, path)
    return s.range(1).select(
        F.lit(passed).alias("passed"), F.posexplode(F.split(F.lit(text), "\n")).alias("line", "text")
    )


Q["c11_validate_path"] = _validated_file
S["c11_validate_path"] = CHECKS + f""", parts AS ({REPORT_PARTS}), lines AS (
  SELECT part, unnest(range(len(lines))) AS i, unnest(lines) AS text FROM parts
) SELECT (SELECT coalesce(bool_and(status <> 'failed'), true) FROM results) AS passed,
  CAST(row_number() OVER (ORDER BY part, i) - 1 AS INTEGER) AS line, text FROM lines"""

Q["a2_read_training_dir"] = lambda s, d: _training_dir(s, d)
S["a2_read_training_dir"] = prof("SELECT * FROM prof")


def _training_dir(s, d):
    """Two CSV files in one folder; the one with ``churn`` in its name is read."""
    folder = sk.fresh_path(s, "train")
    df = tb.customer_profile(s, d)
    sk.write_processed(df.filter("Churn = 1"), f"{folder}/a_other.csv")
    sk.write_processed(df, f"{folder}/b_churn.csv")
    return rd.read_training_dir(s, folder)


# ---- Q: scalars over real rows ---------------------------------------------------------------
Q["q1_name_contains"] = lambda s, d: tb.table(s, d, "part").agg(
    F.count("*").alias("n"),
    F.count_if(sc.name_contains(F.col("p_type"), "BRASS")).alias("n_brass"),
    F.count_if(sc.name_contains(F.col("p_name"), "a")).alias("n_a"),
)
S["q1_name_contains"] = """SELECT count(*) AS n,
  count(*) FILTER (contains(lower(p_type), 'brass')) AS n_brass,
  count(*) FILTER (contains(lower(p_name), 'a')) AS n_a FROM part"""

Q["q2_text_formats"] = lambda s, d: tb.table(s, d, "lineitem").groupBy("l_returnflag").agg(
    sc.percent_text(F.round(F.avg("l_discount"), 8), 2).alias("pct"),
    sc.fixed_text(F.round(F.avg("l_tax"), 8), 4).alias("fixed"),
)
S["q2_text_formats"] = """SELECT l_returnflag, printf('%.2f', round(avg(l_discount), 8) * 100.0)
  || '%' AS pct, printf('%.4f', round(avg(l_tax), 8)) AS fixed FROM lineitem GROUP BY 1"""

Q["q3_q6_arrays"] = lambda s, d: tb.customer_profile(s, d).select(
    "CustomerID",
    sc.joined(F.array("Gender", "Subscription Type", "Contract Length"), ", ").alias("joined"),
    sc.max_of(F.array("Support Calls", "Payment Delay")).alias("largest"),
    sc.max_abs(F.array(-F.col("Support Calls"), F.col("Age") - 50)).alias("largest_abs"),
    F.size(sc.flattened(F.array(F.array("Age", "Churn"), F.array("Age")))).alias("n_flat"),
)
S["q3_q6_arrays"] = prof("""SELECT "CustomerID", concat_ws(', ', "Gender", "Subscription Type",
  "Contract Length") AS joined, greatest("Support Calls", "Payment Delay") AS largest,
  greatest(abs(-"Support Calls"), abs("Age" - 50)) AS largest_abs, CAST(3 AS INTEGER) AS n_flat
  FROM prof""")

Q["q4_strip_prefix"] = lambda s, d: tb.table(s, d, "part").select(
    "p_partkey", sc.strip_prefix(F.concat(F.lit("model__"), "p_brand")).alias("name")
)
S["q4_strip_prefix"] = "SELECT p_partkey, p_brand AS name FROM part"

Q["q5_epoch_difference"] = lambda s, d: tb.ledger_jobs(s, d).select(
    "job", sc.hours_between(F.col("started"), F.col("ended")).alias("hours"),
    sc.minutes_between(F.col("started"), F.col("ended")).alias("minutes"),
)
S["q5_epoch_difference"] = f"""WITH {PRICES}, {JOBS} SELECT job,
  (epoch_us(ended) - epoch_us(started)) / CAST(1000000.0 AS DOUBLE) / CAST(3600.0 AS DOUBLE) AS hours,
  (epoch_us(ended) - epoch_us(started)) / CAST(1000000.0 AS DOUBLE) / CAST(60.0 AS DOUBLE) AS minutes
  FROM jobs"""

# Q7: pages of at most 1,000 customers, so no cell grows with the table
_PAGE = "cast(floor(cast(substring(CustomerID, 10, 20) as bigint) / 1000) as bigint)"
Q["q7_records_json"] = lambda s, d: tb.customer_profile(s, d).groupBy(
    "Age", F.expr(_PAGE).alias("page")
).agg(
    F.sort_array(F.collect_list(F.when(
        F.col("Support Calls") >= 5, F.struct("CustomerID", "Churn")
    ))).alias("r")
).select("Age", "page", sc.records_json(F.col("r")).alias("records"))
S["q7_records_json"] = prof("""SELECT "Age", CAST(substr("CustomerID", 10) AS BIGINT) // 1000 AS page,
  '[' || coalesce(string_agg('{"CustomerID":"'
  || "CustomerID" || '","Churn":' || "Churn" || '}', ',' ORDER BY "CustomerID")
  FILTER ("Support Calls" >= 5), '') || ']' AS records FROM prof GROUP BY 1, 2""")

QUERIES, ORACLES = Q, S
__all__ = ["QUERIES", "ORACLES"]
