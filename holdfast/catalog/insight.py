"""Registered queries: statistics (I), ranking (J), rules (K), metrics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.catalog.base import (
    LIMIT, NOW, SCORE, any_rule, bucket_sql, prof, rule_sql, scored, types_sql, union_all,
)
from holdfast.catalog.exploration import EDGES_CTE, QCUT_SQL, QLABELS
from holdfast.operators import explain, metrics, profile as pr, rank, rules, stats
from holdfast.operators.clean import having_min
from holdfast.operators.split import add_folds
from holdfast.plans import results as res
from holdfast.schema import CATEGORICAL, DELAY_EDGES, FIXED_SPEND_LIMIT, NUMERIC, TARGET
from holdfast.sources import tables as tb

Q, S = {}, {}
Q20 = "(SELECT q20 FROM spend)"


# ---- I: statistics ---------------------------------------------------------------------------
def _fitted(s, d):
    df = tb.profile_table(s, d)
    return rules.rule_analysis(df, rules.fit_rules(df))


_ANALYSIS = {**rule_sql(Q20), "combined": any_rule(Q20)}
Q["i1_rule_analysis"] = _fitted
S["i1_rule_analysis"] = prof(union_all(
    f"""SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS "count",
    round(count(*) FILTER ({cond}) * CAST(100.0 AS DOUBLE) / count(*), 1) AS pct,
    round(coalesce(avg("Churn") FILTER ({cond}), 0), 4) AS churn_rate FROM prof"""
    for name, cond in _ANALYSIS.items()
), LIMIT)


def _rate_sql(key: str, src: str = "prof", having: str = "") -> str:
    return (f'SELECT {key} AS value, round(avg("Churn"), 6) AS rate, count("Churn") AS "count" '
            f"FROM {src} WHERE {key} IS NOT NULL GROUP BY 1 {having}")


Q["i2_rate_by"] = lambda s, d: stats.rate_by(tb.customer_profile(s, d), "Contract Length", TARGET)
S["i2_rate_by"] = prof(_rate_sql('"Contract Length"'))

Q["i2_rate_by_labels"] = lambda s, d: stats.rate_by(tb.table(s, d, "labels"), "quality", "toxic")
S["i2_rate_by_labels"] = """SELECT quality AS value, round(avg(toxic), 6) AS rate,
  count(toxic) AS "count" FROM labels WHERE quality IS NOT NULL GROUP BY 1"""

Q["i3_rate_by_many"] = lambda s, d: stats.rate_by_many(
    tb.customer_profile(s, d), CATEGORICAL, TARGET
)
S["i3_rate_by_many"] = prof(union_all(
    f"""SELECT '{c}' AS "column", * FROM ({_rate_sql(f'"{c}"')})""" for c in CATEGORICAL
))

Q["i4_crosstab_pct"] = lambda s, d: stats.crosstab_pct(
    tb.customer_profile(s, d), "Contract Length", TARGET, [0, 1]
)
S["i4_crosstab_pct"] = prof("""SELECT "Contract Length" AS value,
  round(count(*) FILTER ("Churn" = 0) * CAST(100.0 AS DOUBLE) / count(*), 6) AS pct_0,
  round(count(*) FILTER ("Churn" = 1) * CAST(100.0 AS DOUBLE) / count(*), 6) AS pct_1
  FROM prof GROUP BY 1""")

Q["i5_rate_by_value"] = lambda s, d: having_min(
    stats.rate_by_value(tb.customer_profile(s, d), "Support Calls", TARGET), 100
)
S["i5_rate_by_value"] = prof(_rate_sql('"Support Calls"', having='HAVING count("Churn") > 100'))

Q["i6_rate_by_bin"] = lambda s, d: stats.rate_by_bin(
    tb.customer_profile(s, d), "Payment Delay", DELAY_EDGES, TARGET
)
S["i6_rate_by_bin"] = prof(
    _rate_sql("bin", "binned"),
    f"""binned AS (SELECT *, {bucket_sql('"Payment Delay"', DELAY_EDGES)} AS bin FROM prof)""",
)

Q["i7_rate_by_qbin"] = lambda s, d: stats.rate_by_qbin(
    tb.profile_table(s, d), "Total Spend", 5, TARGET, QLABELS
)
S["i7_rate_by_qbin"] = prof(
    _rate_sql("bin", "binned"), EDGES_CTE,
    f"binned AS (SELECT *, {QCUT_SQL} AS bin FROM prof, edges)",
)


def _threshold(s, d):
    df = tb.profile_table(s, d)
    limit = rules.fit_threshold(df)
    return df.agg(
        F.round(F.lit(limit), 6).alias("threshold"),
        F.count_if(F.col("`Total Spend`") <= F.lit(limit)).alias("at_or_below"),
    )


Q["i8_k2_quantile"] = _threshold
S["i8_k2_quantile"] = prof(
    f"""SELECT round({Q20}, 6) AS threshold, count(*) FILTER ("Total Spend" <= {Q20}) AS at_or_below
    FROM prof""", LIMIT,
)

Q["i9_target_corr"] = lambda s, d: stats.target_corr(tb.customer_profile(s, d), NUMERIC, TARGET)
S["i9_target_corr"] = prof(union_all(
    f"""SELECT '{c}' AS feature, round(corr("{c}", "Churn"), 6) AS corr FROM prof"""
    for c in NUMERIC
))

Q["i10_corr_matrix"] = lambda s, d: stats.corr_matrix(
    tb.customer_profile(s, d), [*NUMERIC, TARGET]
).withColumn("corr", F.round("corr", 6))
S["i10_corr_matrix"] = prof(union_all(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr("{a}", "{b}"), 6) AS corr
    FROM prof""" for a in [*NUMERIC, TARGET] for b in [*NUMERIC, TARGET]
))



def _repeated(s, d):
    """All columns; the rows of one age are planted twice."""
    df = tb.customer_profile(s, d)
    return stats.dup_rows(df.unionByName(df.filter("Age = 30")))


Q["i11_dup_rows"] = _repeated
S["i11_dup_rows"] = prof(
    """SELECT (SELECT count(*) FROM twice) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice))
    AS duplicates""",
    'twice AS (SELECT * FROM prof UNION ALL SELECT * FROM prof WHERE "Age" = 30)',
)
Q["i12_dup_keys"] = lambda s, d: stats.dup_keys(tb.table(s, d, "lineitem"), "l_orderkey")
S["i12_dup_keys"] = "SELECT count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem"

Q["i13_distinct_values"] = lambda s, d: stats.distinct_values(
    tb.customer_profile(s, d), "Subscription Type"
)
S["i13_distinct_values"] = prof('SELECT DISTINCT "Subscription Type" AS value FROM prof')


def _subset(s, d):
    df = tb.profile_table(s, d)
    return stats.subset_report(df, ~rules.fit_rules(df).mask(), TARGET)


Q["i14_subset_report"] = _subset
S["i14_subset_report"] = prof(f"""SELECT count(*) AS total_rows,
  round(avg("Churn"), 4) AS total_rate, count(*) FILTER (NOT {any_rule(Q20)}) AS "rows",
  round(avg("Churn") FILTER (NOT {any_rule(Q20)}), 4) AS rate,
  round(count(*) FILTER (NOT {any_rule(Q20)}) * CAST(100.0 AS DOUBLE) / count(*), 1)
    AS pct_of_total FROM prof""", LIMIT)

# three closed-form scorers stand in for trained models, so that every number has a SQL twin
MODELS = {"plain": 0.0, "eager": 0.4, "shy": -0.4}


def _runs(s, d):
    """Accuracy of every scorer per fold."""
    df = add_folds(tb.profile_table(s, d), TARGET, 5)
    parts = [
        df.select(F.lit(m).alias("model"), "fold", F.col(TARGET).alias("label"),
                  (tb.closed_form_score(lift=lift) > 0.5).cast("int").alias("prediction"))
        for m, lift in MODELS.items()
    ]
    return stats.union_results(parts).groupBy("model", "fold").agg(
        F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("score")
    )


_RUNS = """folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY "Churn"
    ORDER BY md5('42:' || "CustomerID"), "CustomerID") - 1) % 5 AS INTEGER) AS fold FROM prof
), runs AS (""" + union_all(
    f"""SELECT '{m}' AS model, fold, round(avg(CASE WHEN CAST({SCORE.format(lift=lift)} > 0.5
    AS INTEGER) = "Churn" THEN 1 ELSE 0 END), 6) AS score FROM folded GROUP BY 2"""
    for m, lift in MODELS.items()
) + ")"
Q["i16_cv_summary"] = lambda s, d: stats.cv_summary(_runs(s, d))
S["i16_cv_summary"] = prof("""SELECT model, count(score) AS folds, round(avg(score), 6) AS mean,
  round(stddev_pop(score), 6) AS std, round(avg(score) - 2 * stddev_pop(score), 6) AS low,
  round(avg(score) + 2 * stddev_pop(score), 6) AS high FROM runs GROUP BY 1""", _RUNS)

Q["i17_set_diff"] = lambda s, d: stats.set_diff(
    tb.table(s, d, "customer").select("c_custkey"),
    tb.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")),
)
S["i17_set_diff"] = "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders"


def _stacked(s, d):
    """Model rows with and without a cross-validation score."""
    cv = stats.cv_summary(_runs(s, d)).select("model", "mean")
    df = tb.customer_profile(s, d)
    ensemble = df.agg(F.lit("ensemble").alias("model"), F.round(F.avg(TARGET), 6).alias("rate"))
    return stats.union_results([cv, ensemble])


Q["i18_union_results"] = _stacked
S["i18_union_results"] = prof("""SELECT model, round(avg(score), 6) AS mean, NULL AS rate FROM runs
  GROUP BY 1 UNION ALL SELECT 'ensemble', NULL, round(avg("Churn"), 6) FROM prof""", _RUNS)


# ---- J: ranking ------------------------------------------------------------------------------
def importance_of(df):
    """Importance table from the data: size of the correlation, larger ones only."""
    corr = stats.target_corr(df, NUMERIC, TARGET)
    return corr.select("feature", F.round(F.abs("corr"), 4).alias("importance")).filter(
        "importance >= 0.005"
    )


IMPORTANCE = "importance AS (SELECT * FROM (" + union_all(
    f"""SELECT '{c}' AS feature, round(abs(round(corr("{c}", "Churn"), 6)), 4) AS importance
    FROM prof""" for c in NUMERIC
) + ") WHERE importance >= 0.005)"
Q["j1_top_importance"] = lambda s, d: rank.top_importance(
    importance_of(tb.customer_profile(s, d)), 3
)
S["j1_top_importance"] = prof(
    "SELECT * FROM importance ORDER BY importance DESC, feature LIMIT 3", IMPORTANCE
)

COEF = {
    "Age": -0.01, "Tenure": -0.02, "Usage Frequency": -0.03, "Support Calls": 0.1,
    "Payment Delay": 0.05,
}


def contributions(s, d):
    df = tb.profile_table(s, d).dropna()
    means = {c: round(m, 6) for c, m in explain.background_means(df, list(COEF)).items()}
    return explain.shap_linear(df, COEF, means, "CustomerID"), means


CONTRIB = (
    'clean AS (SELECT * FROM prof WHERE '
    + " AND ".join(f'"{c}" IS NOT NULL' for c in NUMERIC) + "), contrib AS ("
    + union_all(
        f"""SELECT "CustomerID" AS row_id, '{c}' AS feature, CAST("{c}" AS DOUBLE) AS value,
        CAST({w} AS DOUBLE) * ("{c}" - (SELECT round(avg("{c}"), 6) FROM clean)) AS shap
        FROM clean""" for c, w in COEF.items()
    ) + ")"
)
TOP = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, direction
  ORDER BY abs(shap) DESC, feature) AS rank FROM (SELECT *, CASE WHEN shap > 0 THEN 'positive'
  ELSE 'negative' END AS direction FROM contrib WHERE shap <> 0)) WHERE rank <= {k})"""
Q["j2_top_factors"] = lambda s, d: rank.top_factors(
    contributions(s, d)[0], 2, "row_id", "shap"
).select("row_id", "feature", "direction", "rank", F.round("shap", 9).alias("shap"))
S["j2_top_factors"] = prof(
    """SELECT row_id, feature, direction, CAST(rank AS INTEGER) AS rank, round(shap, 9) AS shap
    FROM top""", CONTRIB, TOP.format(k=2),
)

_BOARD = "board AS (SELECT model, round(avg(score), 4) AS score FROM runs GROUP BY 1)"


def _board(s, d):
    return _runs(s, d).groupBy("model").agg(F.round(F.avg("score"), 4).alias("score"))


Q["j3_leaderboard"] = lambda s, d: rank.leaderboard(_board(s, d), "score")
S["j3_leaderboard"] = prof("SELECT * FROM board", _RUNS, _BOARD)
Q["j3_best_model"] = lambda s, d: rank.best_by(_board(s, d), "score")
S["j3_best_model"] = prof("SELECT * FROM board ORDER BY score DESC, model LIMIT 1", _RUNS, _BOARD)
Q["j4_metric_range"] = lambda s, d: rank.metric_range(_board(s, d), "score")
S["j4_metric_range"] = prof("SELECT min(score) AS low, max(score) AS high FROM board",
                            _RUNS, _BOARD)

POINTS = """points AS (SELECT p AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1)
  WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""
Q["j5_roc_points"] = lambda s, d: rank.roc_points(tb.scored_profile(s, d))
S["j5_roc_points"] = scored("""SELECT threshold, round(CAST(fp AS DOUBLE) / nn, 6) AS fpr,
  round(CAST(tp AS DOUBLE) / np, 6) AS tpr FROM points UNION ALL SELECT NULL, 0.0, 0.0""", POINTS)
Q["j6_pr_points"] = lambda s, d: rank.pr_points(tb.scored_profile(s, d))
S["j6_pr_points"] = scored("""SELECT threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS
  precision, round(CAST(tp AS DOUBLE) / np, 6) AS recall FROM points
  UNION ALL SELECT NULL, 1.0, 0.0""", POINTS)

Q["j7_recent_jobs"] = lambda s, d: rank.recent_jobs(tb.ledger_jobs(s, d), NOW, 30, 5).select(
    "job", "created"
)
S["j7_recent_jobs"] = f"""SELECT 'job-' || o_orderkey AS job, o_orderdate AS created FROM orders
  WHERE o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 30 DAYS
  ORDER BY o_orderdate DESC, job LIMIT 5"""

Q["j8_top_pairs"] = lambda s, d: rank.top_pairs(
    stats.corr_matrix(tb.customer_profile(s, d), NUMERIC).select(
        F.col("feature_a").alias("feature_1"), F.col("feature_b").alias("feature_2"),
        F.round(F.abs("corr"), 4).alias("interaction_strength"),
    ), 5,
)
S["j8_top_pairs"] = prof(
    "SELECT * FROM (" + union_all(
        f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2,
        round(abs(round(corr("{a}", "{b}"), 6)), 4) AS interaction_strength FROM prof"""
        for a in NUMERIC for b in NUMERIC if a < b
    ) + ") ORDER BY interaction_strength DESC, feature_1, feature_2 LIMIT 5"
)
Q["j9_take_n"] = lambda s, d: rank.take_n(tb.customer_profile(s, d), 100, "CustomerID")
S["j9_take_n"] = prof('SELECT * FROM prof ORDER BY "CustomerID" LIMIT 100')


# ---- K: rules --------------------------------------------------------------------------------
def _masked(s, d):
    df = tb.profile_table(s, d)
    return rules.rule_mask(df, rules.fit_rules(df)).select("CustomerID", "deterministic")


Q["k1_k4_rule_mask"] = _masked
S["k1_k4_rule_mask"] = prof(
    f'SELECT "CustomerID", {any_rule(Q20)} AS deterministic FROM prof', LIMIT
)
Q["k3_fixed_threshold"] = lambda s, d: rules.rule_analysis(
    tb.customer_profile(s, d), rules.churn_rules(FIXED_SPEND_LIMIT)
)
S["k3_fixed_threshold"] = prof(union_all(
    f"""SELECT '{name}' AS rule, count(*) FILTER ({cond}) AS "count",
    round(count(*) FILTER ({cond}) * CAST(100.0 AS DOUBLE) / count(*), 1) AS pct,
    round(coalesce(avg("Churn") FILTER ({cond}), 0), 4) AS churn_rate FROM prof"""
    for name, cond in {**rule_sql("405.0"), "combined": any_rule("405.0")}.items()
))

_SURE = "→ 100% churn in training data"
_FIRED = rule_sql("405.0")
_FIRED_TEXT = {
    "high_support_calls": ("Support Calls", f"Support Calls >= 6 {_SURE}"),
    "monthly_contract": ("Contract Length", f"Monthly contract {_SURE}"),
    "high_payment_delay": ("Payment Delay", f"Payment Delay > 20 {_SURE}"),
    "very_low_spend": ("Total Spend", f"Total Spend <= 405.0 {_SURE}"),
}


def _fired(s, d):
    df = rules.fired_rules(tb.customer_profile(s, d), rules.churn_rules())
    return df.select(
        "CustomerID", F.size("fired").alias("n"),
        F.array_join(F.transform("fired", lambda x: F.concat(x["feature"], F.lit("="), x["value"])),
                     "; ").alias("fired"),
    )


Q["k5_fired_rules"] = _fired
S["k5_fired_rules"] = prof(
    'SELECT "CustomerID", CAST('
    + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _FIRED.values())
    + " AS INTEGER) AS n, concat_ws('; ', " + ", ".join(
        f"""CASE WHEN {c} THEN '{_FIRED_TEXT[n][0]}=' || "{_FIRED_TEXT[n][0]}" END"""
        for n, c in _FIRED.items()
    ) + ") AS fired FROM prof"
)


def hybrid(s, d):
    """Hybrid result with the closed-form score in the place of a model."""
    df = tb.profile_table(s, d)
    p = tb.closed_form_score(digits=None)
    return rules.scored_columns(df, rules.fit_rules(df), p, (p > 0.5).cast("int"))


_RAW = SCORE.format(lift="0.0")[len("round("):-len(", 6)")]
HYBRID = f"""hybrid AS (SELECT "CustomerID", "Churn",
  CASE WHEN det THEN 1 ELSE CAST(raw > 0.5 AS INTEGER) END AS churn_prediction,
  round(prob, 4) AS churn_probability, round(1.0 - prob, 4) AS retention_probability,
  CASE WHEN prob >= 0.7 THEN 'HIGH' WHEN prob >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN det THEN 'rules' ELSE 'ml' END AS prediction_source
  FROM (SELECT *, CASE WHEN det THEN 1.0 ELSE raw END AS prob FROM (
    SELECT *, {any_rule(Q20)} AS det, {_RAW} AS raw FROM prof)))"""
_COLS = ["CustomerID", "churn_prediction", "churn_probability", "retention_probability",
         "risk_level", "prediction_source"]
Q["k8_k9_k10_scored_columns"] = lambda s, d: hybrid(s, d).select(*_COLS)
S["k8_k9_k10_scored_columns"] = prof('SELECT * EXCLUDE ("Churn") FROM hybrid', LIMIT, HYBRID)

Q["i15_batch_summary"] = lambda s, d: rules.batch_summary(hybrid(s, d))
S["i15_batch_summary"] = prof("""SELECT count(*) AS total_customers,
  count(*) FILTER (churn_prediction = 1) AS predicted_churners,
  round(count(*) FILTER (churn_prediction = 1) / CAST(count(*) AS DOUBLE), 4) AS churn_rate,
  count(*) FILTER (prediction_source = 'rules') AS rules_engine_matches,
  count(*) FILTER (prediction_source <> 'rules') AS ml_model_predictions,
  count(*) FILTER (risk_level = 'HIGH') AS high_risk_count,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_count,
  count(*) FILTER (risk_level = 'LOW') AS low_risk_count FROM hybrid""", LIMIT, HYBRID)

Q["k13_compare_actual"] = lambda s, d: rules.compare_actual(
    tb.scored_profile(s, d)
).select("CustomerID", "predicted", "actual", "correct")
S["k13_compare_actual"] = scored("""SELECT "CustomerID",
  CASE WHEN p > 0.5 THEN 'CHURN' ELSE 'STAY' END AS predicted,
  CASE WHEN label = 1 THEN 'CHURN' ELSE 'STAY' END AS actual,
  CASE WHEN (p > 0.5) = (label = 1) THEN '✓' ELSE '✗' END AS correct FROM scored""")

Q["n12_rule_explanation"] = lambda s, d: rules.rule_explanation(
    tb.customer_profile(s, d), rules.churn_rules()
).select("CustomerID", "explanation")
S["n12_rule_explanation"] = prof(
    """SELECT "CustomerID", 'DETERMINISTIC CHURN (probability=100%). This customer matches ' || ("""
    + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _FIRED.values())
    + ") || ' rule(s): ' || concat_ws(', ', " + ", ".join(
        f"CASE WHEN {c} THEN '{_FIRED_TEXT[n][1]}' END" for n, c in _FIRED.items()
    ) + f") AS explanation FROM prof WHERE {any_rule('405.0')}"
)

# ---- M: metrics ------------------------------------------------------------------------------
CONFUSION = """cm AS (SELECT
  count(*) FILTER (label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM {src})"""
CM = CONFUSION.format(src="scored")
_D = "CAST({} AS DOUBLE)"
ACC = "CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)"
PREC = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)"
REC = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)"
F1 = "coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)"
MCC = """coalesce(CAST(tp * tn - fp * fn AS DOUBLE) / nullif(sqrt(tp + fp) * sqrt(tp + fn)
  * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)"""
CHANCE = """(CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(tn + fn AS DOUBLE) * (tn + fp))
  / (CAST(tp + tn + fp + fn AS DOUBLE) * (tp + tn + fp + fn))"""
KAPPA = f"coalesce(({ACC} - {CHANCE}) / nullif(1 - {CHANCE}, 0), 0)"
AUC = "(SELECT sum(neg * (tp - pos) + 0.5 * neg * pos) / any_value(CAST(np AS DOUBLE) * nn) FROM points)"
AP = "(SELECT sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / any_value(np) FROM points)"
LOGLOSS = """(SELECT avg(CASE WHEN label = 1 THEN -ln(greatest(2.220446049250313e-16,
  least(1 - 2.220446049250313e-16, p))) ELSE -ln(1 - greatest(2.220446049250313e-16,
  least(1 - 2.220446049250313e-16, p))) END) FROM scored)"""
BRIER = "(SELECT avg(power(p - label, 2)) FROM scored)"

Q["m1_confusion"] = lambda s, d: metrics.confusion(tb.scored_profile(s, d))
S["m1_confusion"] = scored("SELECT * FROM cm", CM)
Q["m1_confusion_labels"] = lambda s, d: metrics.confusion(
    tb.table(s, d, "labels"), "quality", "toxic"
)
S["m1_confusion_labels"] = "WITH " + CONFUSION.format(
    src="(SELECT quality AS label, toxic AS prediction FROM labels)"
) + " SELECT * FROM cm"
Q["m2_basic_metrics"] = lambda s, d: metrics.basic_metrics(tb.scored_profile(s, d))
S["m2_basic_metrics"] = scored(
    f"SELECT round({ACC}, 6) AS accuracy, round({PREC}, 6) AS precision, "
    f"round({REC}, 6) AS recall, round({F1}, 6) AS f1 FROM cm", CM,
)
Q["m3_matthews"] = lambda s, d: metrics.matthews(tb.scored_profile(s, d))
S["m3_matthews"] = scored(f"SELECT round({MCC}, 6) AS matthews_corrcoef FROM cm", CM)
Q["m4_kappa"] = lambda s, d: metrics.kappa(tb.scored_profile(s, d))
S["m4_kappa"] = scored(f"SELECT round({KAPPA}, 6) AS cohen_kappa FROM cm", CM)
Q["m5_roc_auc"] = lambda s, d: metrics.roc_auc(tb.scored_profile(s, d))
S["m5_roc_auc"] = scored(f"SELECT round({AUC}, 6) AS roc_auc", POINTS)
Q["m6_average_precision"] = lambda s, d: metrics.average_precision(tb.scored_profile(s, d))
S["m6_average_precision"] = scored(f"SELECT round({AP}, 6) AS avg_precision", POINTS)
Q["m7_log_loss"] = lambda s, d: metrics.log_loss(tb.scored_profile(s, d))
S["m7_log_loss"] = scored(f"SELECT round({LOGLOSS}, 6) AS log_loss")
Q["m8_brier"] = lambda s, d: metrics.brier(tb.scored_profile(s, d))
S["m8_brier"] = scored(f"SELECT round({BRIER}, 6) AS brier_score")

_SEVEN = (
    f"round({ACC}, 6) AS accuracy, round({PREC}, 6) AS precision, round({REC}, 6) AS recall, "
    f"round({F1}, 6) AS f1, round({AUC}, 6) AS roc_auc, round({AP}, 6) AS avg_precision, "
    f"round({MCC}, 6) AS matthews_corrcoef"
)
Q["m9_metric_bundle"] = lambda s, d: metrics.metric_bundle(tb.scored_profile(s, d))
S["m9_metric_bundle"] = scored(
    f"SELECT {_SEVEN}, round({KAPPA}, 6) AS cohen_kappa, round({LOGLOSS}, 6) AS log_loss, "
    f"round({BRIER}, 6) AS brier_score FROM cm", CM, POINTS,
)


def _hybrid_scored(s, d):
    """Hybrid columns as (label, prediction, p); a third and more of the rows share p = 1."""
    df = tb.profile_table(s, d)
    hit = rules.fit_rules(df).mask()
    p = tb.closed_form_score()
    return df.select(
        F.col(TARGET).alias("label"), F.when(hit, 1.0).otherwise(p).alias("p"),
        F.when(hit, 1).otherwise((p > 0.5).cast("int")).alias("prediction"),
    )


Q["m9_hybrid_bundle"] = lambda s, d: metrics.metric_bundle(
    _hybrid_scored(s, d), names=metrics.HYBRID_BUNDLE
)
S["m9_hybrid_bundle"] = prof(
    f"SELECT {_SEVEN} FROM cm", LIMIT,
    f"""scored AS (SELECT "Churn" AS label, CASE WHEN {any_rule(Q20)} THEN 1.0
      ELSE {SCORE.format(lift="0.0")} END AS p, CASE WHEN {any_rule(Q20)} THEN 1
      ELSE CAST({SCORE.format(lift="0.0")} > 0.5 AS INTEGER) END AS prediction FROM prof)""",
    CM, POINTS,
)

_PER = """per AS (SELECT c AS name,
    coalesce(tp / nullif(guessed, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(guessed + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support, tp
  FROM (SELECT CAST(k AS VARCHAR) AS c, CAST(count(*) FILTER (label = k) AS DOUBLE) AS support,
    CAST(count(*) FILTER (prediction = k) AS DOUBLE) AS guessed,
    CAST(count(*) FILTER (label = k AND prediction = k) AS DOUBLE) AS tp
    FROM scored, (VALUES (0), (1)) t(k) GROUP BY 1))"""
Q["m10_class_report"] = lambda s, d: metrics.class_report(tb.scored_profile(s, d))
S["m10_class_report"] = scored("""SELECT name, round(precision, 6) AS precision,
    round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6),
    CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
    round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
    round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
    CAST(sum(support) AS BIGINT) FROM per""", _PER)


def _report(s, d):
    """Metrics of every scorer, the table's numbers and the top features as one document."""
    df = tb.profile_table(s, d)
    rows = [
        metrics.metric_bundle(
            df.select(F.col(TARGET).alias("label"), tb.closed_form_score(lift=lift).alias("p"))
            .withColumn("prediction", (F.col("p") > 0.5).cast("int")), digits=4,
        ).withColumn("model", F.lit(m))
        for m, lift in MODELS.items()
    ]
    report = res.metrics_report(
        stats.union_results(rows), importance_of(df), pr.class_rate(df, TARGET), "plain"
    )
    return res.report_rows(report)


_MODEL_SCORED = {
    m: f"""SELECT '{m}' AS model, "Churn" AS label, p, CAST(p > 0.5 AS INTEGER) AS prediction
    FROM (SELECT *, {SCORE.format(lift=lift)} AS p FROM prof)""" for m, lift in MODELS.items()
}
Q["m11_metrics_report"] = _report
S["m11_metrics_report"] = prof(
    """SELECT 'model' AS section, model AS name, 'accuracy' AS key, round(avg(CASE WHEN label =
      prediction THEN 1 ELSE 0 END), 4) AS value FROM ms GROUP BY 2
    UNION ALL SELECT 'model', model, 'f1', round(2.0 * sum(label * prediction)
      / (sum(label) + sum(prediction)), 4) FROM ms GROUP BY 2
    UNION ALL SELECT 'model', model, 'brier_score', round(avg(power(p - label, 2)), 4) FROM ms
      GROUP BY 2
    UNION ALL SELECT 'final', 'plain', 'accuracy', round(avg(CASE WHEN label = prediction THEN 1
      ELSE 0 END), 4) FROM ms WHERE model = 'plain'
    UNION ALL SELECT 'dataset', 'total_rows', 'value', CAST(count(*) AS DOUBLE) FROM prof
    UNION ALL SELECT 'dataset', 'churn_rate', 'value', round(avg("Churn"), 4) FROM prof
    UNION ALL SELECT 'importance', feature, 'importance', importance FROM (
      SELECT * FROM importance ORDER BY importance DESC, feature LIMIT 10)""",
    "ms AS (" + union_all(_MODEL_SCORED.values()) + ")", IMPORTANCE,
)

QUERIES, ORACLES = Q, S
__all__ = ["QUERIES", "ORACLES", "types_sql"]
