"""Registered queries: models (L), hybrid scoring (K), model-based diagnostics (N), streams (P)."""

from __future__ import annotations

import datetime
import json
import math
from dataclasses import replace

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.catalog.base import LIMIT, NOW, SCORE, any_rule, prof, scored, union_all
from holdfast.functions.features import engineer_v1, engineer_v2
from holdfast.operators import metrics as mx, rules as ru, stats
from holdfast.operators.clean import clean_v2, feature_lists
from holdfast.operators.prep import build_preprocessor
from holdfast.operators.split import stratified_split
from holdfast.plans import (
    attribution as at, boosting as bo, diagnose as dg, models as md, scoring as sg, search as se,
    tree_paths as tp,
)
from holdfast.plans import train as tr, tuning as tu
from holdfast.schema import CATEGORICAL, NUMERIC, TARGET
from holdfast.sources import sinks as sk, tables as tb
from holdfast.streaming import alarms as al, capture as cp, percentiles as pt, windows as wi
from holdfast.streaming.run import drained, event_stream

Q, S = {}, {}

# Single fits run with the sizes of the operators. Jobs of many fits (searches, stacks, comparisons)
# are registered with small settings, so that one machine ends them in seconds.
FOREST: dict = {}
SMALL = {"random_forest": {"numTrees": 20, "maxDepth": 5}, "xgboost": {"maxIter": 10, "maxDepth": 3},
         "gradient_boosting": {"maxIter": 10, "maxDepth": 3}, "svm": {"maxIter": 20},
         "logistic_regression": {}}
GRID = {
    "random_forest": {"numTrees": [10, 20], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
    "xgboost": {"maxIter": [5, 8], "maxDepth": [2, 3], "stepSize": [0.1, 0.3]},
}


def planted(s, d):
    return tb.planted_profile(tb.profile_table(s, d))


def _trained(algorithm, **params):
    def run(s, d):
        df = engineer_v1(clean_v2(planted(s, d)))
        _, found = tr.train_eval(df, algorithm, params)
        return found.withColumn("algorithm", F.lit(algorithm))
    return run


for _i, _name in [
    (1, "logistic_regression"), (2, "random_forest"), (3, "gradient_boosting"), (4, "svm"),
    (5, "decision_tree"),
]:
    Q[f"l{_i}_{_name}"] = _trained(_name)
Q["l6_l15_train_eval"] = _trained("xgboost")
Q["l3_leafwise"] = _trained("lightgbm", maxIter=60)

_FIVE = ["Age", "Tenure", "Usage Frequency", "Support Calls", "Payment Delay"]


def _root(s, d):
    """L3: the first split of a boosted tree, with its gradient and hessian sums."""
    df = tb.profile_table(s, d).dropna()
    rows = VectorAssembler(inputCols=_FIVE, outputCol="features").transform(
        df.withColumn("label", F.col(TARGET).cast("double")))
    (tree,) = bo.Booster(maxIter=1, maxDepth=1, regLambda=1.5, regAlpha=0.25).fit(rows).tree_list()
    left = tree["left"][0]
    return s.createDataFrame(
        [(_FIVE[tree["feature"][0]], tree["threshold"][0], round(tree["gain"][0], 6),
          tree["cover"][left], round(tree["value"][left], 6), round(tree["value"][left + 1], 6))],
        "feature string, threshold double, gain double, n_left long, left_value double, "
        "right_value double")


Q["l3_root_split"] = _root
_SOFT = "power(greatest(abs({0}) - 0.25, 0), 2) / ({1} + 1.5)"
_LEAF = "round(-0.1 * sign({0}) * greatest(abs({0}) - 0.25, 0) / ({1} + 1.5), 6)"
S["l3_root_split"] = prof(f"""SELECT feature, threshold, round(gain, 6) AS gain, nl AS n_left,
    {_LEAF.format("gl", "hl")} AS left_value, {_LEAF.format("gt - gl", "ht - hl")} AS right_value
  FROM (SELECT *, 0.5 * ({_SOFT.format("gl", "hl")} + {_SOFT.format("gt - gl", "ht - hl")}
      - {_SOFT.format("gt", "ht")}) AS gain
    FROM (SELECT j, feature, CAST(v AS DOUBLE) AS threshold, sum(n) OVER w AS nl,
        sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY j) AS gt,
        sum(h) OVER (PARTITION BY j) AS ht, sum(n) OVER (PARTITION BY j) AS nt
      FROM (SELECT j, feature, v, count(*)::BIGINT AS n, sum(0.5 - y)::DOUBLE AS g,
          (count(*) * 0.25)::DOUBLE AS h
        FROM ({union_all(f"""SELECT {j} AS j, '{c}' AS feature, "{c}" AS v, "Churn" AS y FROM clean"""
                         for j, c in enumerate(_FIVE))}) GROUP BY j, feature, v)
      WINDOW w AS (PARTITION BY j ORDER BY v))
    WHERE least(hl, ht - hl) >= 1 AND nl < nt)
  ORDER BY gain DESC, j, threshold LIMIT 1""", "clean AS (SELECT * FROM prof WHERE " + " AND ".join(
    f'"{c}" IS NOT NULL' for c in NUMERIC) + ")")


def _boosters(s, d):
    """Both ways of growth learn the planted signal and keep their limits."""
    df = engineer_v1(clean_v2(planted(s, d)))
    rows = []
    for name, params in [("xgboost", {"maxIter": 10, "maxDepth": 4, "gamma": 0.1}),
                         ("lightgbm", {"maxIter": 10, "numLeaves": 9})]:
        fitted, found = tr.train_eval(df, name, params)
        trees = fitted.classifier.tree_list()
        leaves = max(sum(x < 0 for x in t["left"]) for t in trees)
        rows.append((name, len(trees), found.first()["roc_auc"] > 0.6, leaves <= (
            2 ** 4 if name == "xgboost" else 9), all(t["gain"][n] > 0 for t in trees for n in t["order"])))
    return s.createDataFrame(rows, "algorithm string, trees int, learned boolean, within boolean, "
                                   "all_gain boolean")


Q["l3_l6_boosters"] = _boosters
S["l3_l6_boosters"] = """SELECT * FROM (VALUES ('xgboost', 10, true, true, true),
  ('lightgbm', 10, true, true, true)) t(algorithm, trees, learned, within, all_gain)"""

Q["l7_class_weights"] = lambda s, d: md.class_weights(tb.customer_profile(s, d))
S["l7_class_weights"] = prof("""SELECT "Churn" AS value, count(*) AS n,
  round((SELECT count(*) FROM prof) / (2.0 * count(*)), 9) AS weight FROM prof GROUP BY 1""")
Q["l7_class_weights_unbalanced"] = lambda s, d: md.class_weights(
    tb.customer_profile(s, d), mode="unbalanced"
)
S["l7_class_weights_unbalanced"] = prof("""SELECT "Churn" AS value, count(*) AS n,
  CASE WHEN "Churn" = 1 THEN round((SELECT count(*) FROM prof WHERE "Churn" = 0)
    / CAST(count(*) AS DOUBLE), 9) ELSE 1.0 END AS weight FROM prof GROUP BY "Churn" """)


def _prepared(s, d):
    df = clean_v2(planted(s, d))
    numeric, categorical = feature_lists(df)
    return df, build_preprocessor(df, numeric, categorical)


def _search(s, d):
    df, pre = _prepared(s, d)
    return tu.random_search(df, "random_forest", GRID["random_forest"], 3, 3, pre)[2]


Q["l8_random_search"] = _search


def _quick(s, d):
    df, pre = _prepared(s, d)
    space = {**tu.RANGES["random_forest"], "numTrees": ("int", 5, 15), "maxDepth": ("int", 3, 6)}
    return se.quick_tune(df, "random_forest", pre, 3, 2, space=space)


Q["l9_l16_quick_tune"] = _quick


def _search_holds(s, d):
    """A search from its ledger alone gives the same trials; the best one is completed and learns."""
    df, pre = _prepared(s, d)
    space = {"maxDepth": ("int", 2, 8), "minInstancesPerNode": ("int", 1, 10)}
    path = sk.fresh_path(s, "ledger")
    first, again = (se.search(df, "decision_tree", space, 6, 3, pre, ledger=path) for _ in range(2))
    scores = s.read.parquet(path).count()
    trials = first[2].collect()
    return s.createDataFrame([(
        len(trials), first[:2] == again[:2] and trials == again[2].collect(),
        scores == sum(t["rungs"] for t in trials), first[1] > 0.6,
        first[1] == max(t["objective"] for t in trials if t["status"] == "Completed"))],
        "trials int, same_again boolean, scored_once boolean, learned boolean, best_completed boolean")


Q["l9_search_ledger"] = _search_holds
S["l9_search_ledger"] = """SELECT 6 AS trials, true AS same_again, true AS scored_once,
  true AS learned, true AS best_completed"""


def _stacked(s, d):
    df = clean_v2(planted(s, d))
    marked = stratified_split(df, TARGET)
    train, test = marked.filter("is_train").drop("is_train"), marked.filter("NOT is_train")
    numeric, categorical = feature_lists(df)
    pre = build_preprocessor(train, numeric, categorical)
    models = {n: md.make_model(n, SMALL[n]) for n in ("random_forest", "xgboost")}
    return tr.evaluate(tr.stack(train, models, pre, 3, balanced=True), test)


Q["l10_l11_stack"] = _stacked

_TWO = {"plain": 0.0, "ensemble": 0.4}


def _choice(s, d):
    """Two scorers, the ensemble wins ties."""
    df = tb.profile_table(s, d)
    rows = [
        mx.basic_metrics(df.select(
            F.col(TARGET).alias("label"),
            (tb.closed_form_score(lift=lift) > 0.5).cast("int").alias("prediction"),
        ), digits=4).select(F.lit(m).alias("model"), "f1")
        for m, lift in _TWO.items()
    ]
    return tr.choose_final_rows(stats.union_results(rows), "ensemble")


Q["l12_choose_final"] = _choice
S["l12_choose_final"] = prof("SELECT * FROM (" + union_all(
    f"""SELECT '{m}' AS model, round(2.0 * sum(g * "Churn") / (sum(g) + sum("Churn")), 4) AS f1
    FROM (SELECT "Churn", CAST({SCORE.format(lift=lift)} > 0.5 AS INTEGER) AS g FROM prof)"""
    for m, lift in _TWO.items()
) + ") ORDER BY f1 DESC, model = 'ensemble' DESC LIMIT 1")

Q["l13_compare_models"] = lambda s, d: tr.compare_models(
    clean_v2(planted(s, d)), ("logistic_regression", "random_forest", "gradient_boosting", "svm"),
    2, SMALL,
)[1].drop("seconds")


def _importance(s, d):
    df = clean_v2(planted(s, d))
    fitted = md.fit_pipeline(df, md.rf(**FOREST), "random_forest")
    return md.feature_importance(s, fitted)


Q["l17_feature_importance"] = _importance


def _learned(s, d):
    """Models find the planted signal, with class weights and without."""
    df = engineer_v1(clean_v2(planted(s, d)))
    rows = []
    for name, params in [("decision_tree", {}), ("random_forest", {"weightCol": "w_balanced"}),
                         ("logistic_regression", {"weightCol": "w_unbalanced"})]:
        found = tr.train_eval(df, name, params)[1].first()
        rows.append((name, params.get("weightCol", "none"),
                     found["accuracy"] > 0.6 and found["roc_auc"] > 0.6))
    return s.createDataFrame(rows, "algorithm string, weights string, learned boolean")


Q["l1_l5_learned"] = _learned
S["l1_l5_learned"] = """SELECT * FROM (VALUES ('decision_tree', 'none', true),
  ('random_forest', 'w_balanced', true), ('logistic_regression', 'w_unbalanced', true))
  t(algorithm, weights, learned)"""


def _importance_sum(s, d):
    found = _importance(s, d)
    return found.agg(F.round(F.sum("importance"), 6).alias("total"),
                     F.bool_and(F.col("importance") >= 0).alias("none_negative"))


Q["l17_importance_sum"] = _importance_sum
S["l17_importance_sum"] = "SELECT CAST(1.0 AS DOUBLE) AS total, true AS none_negative"

PLAN = {"algorithms": ("xgboost", "random_forest"), "grids": GRID, "n_iter": 1, "tune_folds": 2,
        "stack_folds": 2}
Q["l18_train_v1"] = lambda s, d: tr.train_v1(planted(s, d), tr.plan_v1(**PLAN)).rows(s)


def _train_v2(s, d):
    """Metrics of all models on the open rows, and of the hybrid on the hold-out."""
    out = tr.train_v2(planted(s, d), tr.plan_v2(**PLAN))
    hybrid = s.createDataFrame(
        [("hybrid", *out.hybrid_metrics.values())],
        "model string, " + ", ".join(f"{n} double" for n in out.hybrid_metrics),
    )
    return stats.union_results([out.rows(s), hybrid])


Q["l18_k14_train_v2"] = _train_v2


# ---- K: hybrid scoring with a model ----------------------------------------------------------
def hybrid_model(s, d):
    df = clean_v2(planted(s, d))
    rules = ru.fit_rules(df)
    open_rows = engineer_v2(df.filter(~rules.mask()))
    return tr.Hybrid(rules, md.fit_pipeline(open_rows, md.rf(**FOREST), "random_forest")), df


def _hybrid(s, d):
    hybrid, df = hybrid_model(s, d)
    return hybrid.score(df).select("CustomerID", "prediction", F.round("p", 6).alias("p"),
                                   "prediction_source")


Q["k6_k7_hybrid_predict"] = _hybrid


def _batch(s, d):
    hybrid, df = hybrid_model(s, d)
    return sg.score_batch(df, hybrid, NOW)


Q["k11_score_batch"] = _batch

_CLEAN = 'clean AS (SELECT * FROM prof WHERE ' + " AND ".join(
    f'"{c}" IS NOT NULL' for c in NUMERIC) + ")"
_SPEND = LIMIT.replace("FROM prof", "FROM clean")


def _hybrid_counts(s, d):
    """K6, K7: who decided how many rows, and that scores are scores."""
    hybrid, df = hybrid_model(s, d)
    return hybrid.score(df).groupBy("prediction_source").agg(
        F.count("*").alias("n"), F.bool_and(F.col("p").between(0, 1)).alias("p_valid"),
        F.bool_and(F.col("prediction").isin(0, 1)).alias("prediction_valid"),
        F.bool_and((F.col("prediction_source") == "ml") | (F.col("prediction") == 1)).alias("sure"),
    )


Q["k6_k7_hybrid_counts"] = _hybrid_counts
S["k6_k7_hybrid_counts"] = prof(
    f"""SELECT CASE WHEN {any_rule("(SELECT q20 FROM spend)")} THEN 'rules' ELSE 'ml' END
    AS prediction_source, count(*) AS n, true AS p_valid, true AS prediction_valid, true AS sure
    FROM clean GROUP BY 1""", _CLEAN, _SPEND,
)


def _batch_counts(s, d):
    """Every row is scored once, and churners are those above one half."""
    hybrid, df = hybrid_model(s, d)
    found = sg.score_batch(df, hybrid, NOW)
    return found.agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("n_ids"))


Q["k11_score_counts"] = _batch_counts
S["k11_score_counts"] = prof(
    'SELECT count(*) AS n, count(DISTINCT "CustomerID") AS n_ids FROM clean', _CLEAN)


def _confidence(s, d):
    df = clean_v2(planted(s, d))
    fitted = md.fit_pipeline(df, md.tree(), "decision_tree")
    return fitted.score(df).select("CustomerID", "prediction", F.round("p", 6).alias("p"),
                                   F.round("confidence", 6).alias("confidence"))


Q["k12_with_confidence"] = _confidence


def _confidence_holds(s, d):
    """The confidence is that of the predicted class."""
    df = clean_v2(planted(s, d))
    found = md.fit_pipeline(df, md.tree(), "decision_tree").score(df)
    return found.agg(
        F.count("*").alias("n"),
        F.bool_and(F.abs(F.greatest("p", 1 - F.col("p")) - F.col("confidence")) < 1e-9)
        .alias("of_the_larger"),
        F.bool_and((F.col("p") > 0.5) == (F.col("prediction") == 1)).alias("of_the_predicted"),
    )


Q["k12_confidence_holds"] = _confidence_holds
S["k12_confidence_holds"] = prof(
    "SELECT count(*) AS n, true AS of_the_larger, true AS of_the_predicted FROM clean", _CLEAN)


def _saved(s, d):
    """A10: a saved pipeline scores exactly like the one in memory."""
    df = clean_v2(planted(s, d))
    fitted = md.fit_pipeline(df, md.tree(), "decision_tree")
    path = sk.fresh_path(s, "model")
    md.save_model(fitted, path, 405.0)
    loaded, limit = md.load_model(s, path)
    pair = fitted.score(df).select("CustomerID", F.col("p").alias("p1")).join(
        loaded.score(df).select("CustomerID", F.col("p").alias("p2")), "CustomerID"
    )
    return pair.agg(F.count("*").alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("same"),
                    F.lit(limit).alias("limit"))


Q["a10_save_load_model"] = _saved
S["a10_save_load_model"] = prof(
    "SELECT count(*) AS n, count(*) AS same, CAST(405.0 AS DOUBLE) AS \"limit\" FROM prof WHERE "
    + " AND ".join(f'"{c}" IS NOT NULL' for c in NUMERIC)
)


def _foreign(s, d):
    """A model that is no Spark model, run through the four hooks."""
    def load():
        return {"Support Calls": 0.1, "Payment Delay": 0.05, "intercept": -0.7}

    def parse(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["CustomerID", "Support Calls", "Payment Delay"]]

    def predict(batch: pd.DataFrame, model) -> pd.DataFrame:
        z = sum(batch[c] * w for c, w in model.items() if c != "intercept") + model["intercept"]
        return batch.assign(z=z)

    def fmt(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"CustomerID": batch["CustomerID"], "z": batch["z"]})

    out = sg.score_with(
        tb.customer_profile(s, d), load, parse, predict, fmt, "CustomerID string, z double"
    )
    return out.withColumn("z", F.round("z", 6))


Q["r3_r4_score_with"] = _foreign
S["r3_r4_score_with"] = prof("""SELECT "CustomerID", round(CAST(0.1 AS DOUBLE) * "Support Calls"
  + CAST(0.05 AS DOUBLE) * "Payment Delay" - 0.7, 6) + 0.0 AS z FROM prof""")


def _user_rules(s, d):
    """User rules as (name, column), and a user feature function."""
    df = tb.customer_profile(s, d).transform(
        lambda x: x.withColumn("load", F.col("Support Calls") + F.col("Payment Delay"))
    )
    mine = ru.RuleSet([("busy", F.col("load") >= 15), ("young", F.col("Age") < 30)])
    return ru.rule_analysis(df, mine)


Q["r1_r2_user_rules"] = _user_rules
_MINE = {"busy": '"Support Calls" + "Payment Delay" >= 15', "young": '"Age" < 30',
         "combined": '("Support Calls" + "Payment Delay" >= 15 OR "Age" < 30)'}
S["r1_r2_user_rules"] = prof(union_all(
    f"""SELECT '{n}' AS rule, count(*) FILTER ({c}) AS "count",
    round(count(*) FILTER ({c}) * CAST(100.0 AS DOUBLE) / count(*), 1) AS pct,
    round(coalesce(avg("Churn") FILTER ({c}), 0), 4) AS churn_rate FROM prof"""
    for n, c in _MINE.items()
))


# ---- N: diagnostics with models --------------------------------------------------------------
def _metric_rows(s, name, found):
    return s.createDataFrame([(name, *found.values())],
                             "test string, " + ", ".join(f"{k} double" for k in found))


Q["n1_baseline"] = lambda s, d: dg.baseline(planted(s, d), FOREST)[1]
Q["n2_shuffled_target"] = lambda s, d: _metric_rows(
    s, "shuffled", dg.shuffled_target_test(planted(s, d), FOREST)
)
Q["n3_single_feature_power"] = lambda s, d: dg.single_feature_power(planted(s, d))
Q["n4_verdict"] = lambda s, d: mx.basic_metrics(tb.scored_profile(s, d)).select(
    "f1", dg.verdict(F.col("f1")).alias("verdict")
)
S["n4_verdict"] = scored("""SELECT f1, CASE WHEN f1 > 0.95 THEN 'too easy' WHEN f1 > 0.85
  THEN 'reasonable' ELSE 'weak' END AS verdict FROM (SELECT round(2.0 * sum(label * prediction)
  / (sum(label) + sum(prediction)), 6) AS f1 FROM scored)""")
Q["n5_leakage_report"] = lambda s, d: dg.leakage_report(planted(s, d), FOREST)

def _closed(df):
    return df.withColumn("p", tb.closed_form_score(digits=None))


def _shap(s, d):
    """Attributions of every row, next to the score they add up to."""
    df = tb.profile_table(s, d).dropna()
    long = at.shap_sampled(df, _closed, df, _FIVE, 4)
    total = long.groupBy("row_id").agg(F.round(F.sum("shap"), 6).alias("total"))
    return total


Q["n8_shap_sampled"] = _shap
S["n8_shap_sampled"] = prof(
    """SELECT "CustomerID" AS row_id, round(1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE)
    * ("Support Calls" - 2) + CAST(0.05 AS DOUBLE) * ("Payment Delay" - 10)))), 6) AS total
    FROM prof WHERE """ + " AND ".join(f'"{c}" IS NOT NULL' for c in NUMERIC)
)


def _kernel(s, d):
    """Kernel-weighted attributions of a closed form over five columns and twenty background rows."""
    df = tb.profile_table(s, d).dropna()
    found = at.kernel_shap(df, _closed, df.orderBy("CustomerID").limit(20), _FIVE)
    return found.groupBy("row_id").agg(*[
        F.round(F.sum(F.when(F.col("feature") == f, F.col("shap"))), 6).alias(a) for f, a in (
            ("Support Calls", "shap_calls"), ("Payment Delay", "shap_delay"), ("(base)", "base"))],
        F.max(F.when(F.col("feature").isin(_FIVE[:3]), F.abs("shap"))).alias("others")).withColumn(
        "others", F.round("others", 9))


Q["n8_kernel_shap"] = _kernel
_P = "1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE) * ({c} - 2) + CAST(0.05 AS DOUBLE) * ({d} - 10))))"
S["n8_kernel_shap"] = prof(f"""SELECT row_id, round(0.5 * (fc - f0 + f - fd), 6) + 0.0 AS shap_calls,
    round(0.5 * (fd - f0 + f - fc), 6) + 0.0 AS shap_delay, round(f0, 6) AS base, 0.0::DOUBLE AS others
  FROM (SELECT x.id AS row_id, avg({_P.format(c="x.c", d="x.d")}) AS f, avg({_P.format(c="x.c", d="b.d")})
      AS fc, avg({_P.format(c="b.c", d="x.d")}) AS fd, avg({_P.format(c="b.c", d="b.d")}) AS f0
    FROM (SELECT "CustomerID" AS id, "Support Calls" AS c, "Payment Delay" AS d FROM clean) x,
      (SELECT "Support Calls" AS c, "Payment Delay" AS d FROM clean ORDER BY "CustomerID" LIMIT 20) b
    GROUP BY x.id)""", _CLEAN)


def _forest(s, d):
    df = clean_v2(planted(s, d))
    return md.fit_pipeline(df, md.rf(**FOREST), "random_forest"), df


def _shap_model(s, d):
    """N8 with a trained forest: exact attributions of every row, summed up per feature."""
    fitted, df = _forest(s, d)
    return tp.tree_shap(df, fitted).groupBy("feature").agg(
        F.round(F.avg(F.abs("shap")), 6).alias("mean_abs_shap"))


Q["n8_tree_shap"] = _shap_model


def _shap_forest_sampled(s, d):
    """N8 with a trained forest, by sampled permutations."""
    df = clean_v2(planted(s, d))
    cols = [*NUMERIC, *CATEGORICAL]
    fitted = md.fit_pipeline(df, md.rf(numTrees=10, maxDepth=4), "random_forest")
    long = at.shap_sampled(df, fitted.score, df, cols, 2)
    return long.groupBy("feature").agg(F.round(F.avg(F.abs("shap")), 6).alias("mean_abs_shap"))


Q["n8_shap_sampled_forest"] = _shap_forest_sampled


def _shap_adds_up(s, d):
    """The attributions of every row add up to its score."""
    df = clean_v2(planted(s, d))
    fitted = md.fit_pipeline(df, md.booster(maxIter=5, maxDepth=4), "xgboost")
    total = tp.tree_shap(df, fitted).groupBy("row_id").agg(F.sum("shap").alias("total"))
    both = total.join(fitted.score(df).select(F.col("CustomerID").alias("row_id"), "p"), "row_id")
    return both.agg(F.count("*").alias("n"), F.count_if(
        F.abs(1 / (1 + F.exp(-F.col("total"))) - F.col("p")) < 1e-9).alias("equal"))


Q["n8_tree_shap_adds_up"] = _shap_adds_up
S["n8_tree_shap_adds_up"] = prof("SELECT count(*) AS n, count(*) AS \"equal\" FROM clean", _CLEAN)


def _stated_tree(s, d):
    """A stated tree over two columns, with the shares of the profile's rows."""
    df = tb.profile_table(s, d).dropna()
    calls, both = F.col("Support Calls") <= 1, (F.col("Support Calls") <= 1) & (
        F.col("Payment Delay") <= 9)
    n, n_calls, n_both = df.agg(F.count("*"), F.count_if(calls), F.count_if(both)).first()
    nodes = {"feature": [0, 1, -1, -1, -1], "threshold": [1.0, 9.0, 0.0, 0.0, 0.0],
             "left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1],
             "value": [0.0, 0.0, 2.0, -1.0, 0.5], "gain": [0.0] * 5, "order": [0, 1],
             "cover": [n, n_calls, n - n_calls, n_both, n_calls - n_both]}
    names = ["Support Calls", "Payment Delay"]
    model = bo.BoostedModel(trees=json.dumps([nodes]), numFeatures=2)
    pipeline = PipelineModel([VectorAssembler(inputCols=names, outputCol="features"), model])
    return md.Fitted("stated", pipeline, names), df


def _stated_paths(s, d):
    """Attributions and the interaction of a stated tree, row by row."""
    fitted, df = _stated_tree(s, d)
    names = fitted.feature_names
    shap = tp.tree_shap(df, fitted).groupBy("row_id").agg(*[
        F.round(F.sum(F.when(F.col("feature") == f, F.col("shap"))), 6).alias(a)
        for f, a in ((names[0], "shap_calls"), (names[1], "shap_delay"), ("(base)", "base"))])
    pair = tp.tree_interactions(df, fitted).where("feature_1 <> feature_2").select(
        "row_id", F.round("interaction", 6).alias("pair"))
    return shap.join(pair, "row_id")


Q["n8_n13_tree_paths"] = _stated_paths
S["n8_n13_tree_paths"] = prof("""SELECT row_id, round(0.5 * (fc - f0 + fcd - fd), 6) + 0.0 AS shap_calls,
    round(0.5 * (fd - f0 + fcd - fc), 6) + 0.0 AS shap_delay, round(f0, 6) AS base,
    round(fcd - fc - fd + f0, 6) + 0.0 AS pair
  FROM (SELECT *, pc * low + (1 - pc) * 2.0 AS f0, CASE WHEN c THEN low ELSE 2.0 END AS fc,
      pc * leaf + (1 - pc) * 2.0 AS fd, CASE WHEN c THEN leaf ELSE 2.0 END AS fcd
    FROM (SELECT "CustomerID" AS row_id, "Support Calls" <= 1 AS c,
        CAST(CASE WHEN "Payment Delay" <= 9 THEN -1.0 ELSE 0.5 END AS DOUBLE) AS leaf, pc,
        -pd + 0.5 * (1 - pd) AS low
      FROM clean, (SELECT avg(CAST("Support Calls" <= 1 AS INTEGER)) AS pc,
        avg(CAST("Payment Delay" <= 9 AS INTEGER)) FILTER ("Support Calls" <= 1) AS pd FROM clean)))""",
                              _CLEAN)


def _pairs(s, d):
    """The strongest pairs of a forest, over all its features."""
    from holdfast.operators.rank import top_pairs
    fitted, df = _forest(s, d)
    return top_pairs(tp.interaction_strength(df, fitted).withColumn(
        "interaction_strength", F.round("interaction_strength", 6)), 5)


Q["n13_interactions"] = _pairs


def _pairs_sampled(s, d):
    """Second differences of a closed form against background rows."""
    from holdfast.operators.rank import top_pairs
    df = tb.profile_table(s, d).dropna()
    return top_pairs(at.interactions(df, _closed, df, _FIVE).withColumn(
        "interaction_strength", F.round("interaction_strength", 6)), 5)


Q["n13_interactions_sampled"] = _pairs_sampled

# ---- rows that must hold for trained jobs ------------------------------------------------------
def _one_row(s, **values):
    return s.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items()))


def _between(*scores):
    return all(0.0 <= x <= 1.0 for x in scores)


def _searched(s, d):
    """Every draw is scored, and the best score is the highest."""
    df, pre = _prepared(s, d)
    best, score, trials = tu.random_search(df, "random_forest", GRID["random_forest"], 3, 3, pre)
    rows = trials.collect()
    scores = [t["objective"] for t in rows]
    return _one_row(s, trials=len(rows), best_is_highest=score == max(scores), valid=_between(*scores),
                    from_grid=all(v in GRID["random_forest"][k] for k, v in best.items()),
                    learned=score > 0.6)


def _stack_learns(s, d):
    """The stack of out-of-fold scores learns the planted signal."""
    m = _stacked(s, d).first().asDict()
    return _one_row(s, learned=m["roc_auc"] > 0.6, better_than_coin=m["accuracy"] > 0.6,
                    valid=_between(m["precision"], m["recall"], m["f1"]))


def _compared(s, d):
    """Every model of the suite, the kernel margin among them, learns."""
    folds, holdout, models = tr.compare_models(
        clean_v2(planted(s, d)), ("logistic_regression", "random_forest", "svm"), 2, SMALL)
    scores = [r["score"] for r in folds.collect()]
    rows = holdout.collect()
    return _one_row(s, models=len(models), fold_scores=len(scores), learned=min(scores) > 0.6,
                    holdout_learned=all(r["roc_auc"] > 0.6 for r in rows),
                    valid=_between(*scores, *(r["f1"] for r in rows)))


def _hybrid_trained(s, d):
    """The chosen model is the best by F1, and the hybrid is measured on held-out rows."""
    out = tr.train_v2(planted(s, d), tr.plan_v2(**PLAN))
    f1 = {m: v["f1"] for m, v in out.metrics.items()}
    best = max(v for m, v in f1.items() if m != "StackingEnsemble")
    stacked = f1["StackingEnsemble"] >= best
    return _one_row(s, models=len(f1), chosen_is_best=(out.final_name == "StackingEnsemble") == stacked,
                    trials=out.trials.count(), recall_of_hybrid=out.hybrid_metrics["recall"] > 0.5,
                    valid=_between(*f1.values()))


def _diagnosed(s, d):
    """The planted drivers lead, permuted labels give chance, each feature has its model."""
    df = planted(s, d)
    found, top, _ = dg.baseline(df, FOREST)
    mixed = dg.shuffled_target_test(df, FOREST)
    single = dg.single_feature_power(df).collect()
    drivers = ["Support Calls", "Payment Delay"]
    return _one_row(s, learned=found["accuracy"] > 0.7, driver_leads=top.first()["feature"] in drivers,
                    chance=mixed["accuracy"] < found["accuracy"] - 0.05, features=len(single),
                    driver_alone=max(single, key=lambda r: r["f1"])["feature"] in drivers)


for _name, _run, _row in (
    ("l8_holds", _searched, "3 AS trials, true AS best_is_highest, true AS valid, true AS from_grid, "
                            "true AS learned"),
    ("l10_l11_holds", _stack_learns, "true AS learned, true AS better_than_coin, true AS valid"),
    ("l4_l13_holds", _compared, "3 AS models, 6 AS fold_scores, true AS learned, "
                                "true AS holdout_learned, true AS valid"),
    ("l18_k14_holds", _hybrid_trained, "3 AS models, true AS chosen_is_best, 2 AS trials, "
                                       "true AS recall_of_hybrid, true AS valid"),
    ("n1_n2_n3_holds", _diagnosed, "true AS learned, true AS driver_leads, true AS chance, "
                                   f"{len(NUMERIC)} AS features, true AS driver_alone"),
):
    Q[_name], S[_name] = _run, f"SELECT {_row}"


def _report_counts(s, d):
    """The counts of the leakage report."""
    return dg.leakage_report(planted(s, d), FOREST).where(
        "key IN ('n', 'count', 'duplicates') AND section IN ('1 classes', '3 duplicates', '10 categories')"
    ).groupBy("section", "item", "key").agg(F.sum("value").cast("long").alias("value"))


Q["n5_leakage_counts"] = _report_counts
S["n5_leakage_counts"] = prof("""SELECT '1 classes' AS section, 'table' AS item, 'n' AS key,
    count(*)::BIGINT AS value FROM prof
  UNION ALL SELECT '3 duplicates', 'table', 'duplicates', 0
  UNION ALL SELECT '3 duplicates', 'CustomerID', 'duplicates', count(*) - count(DISTINCT "CustomerID")
    FROM prof
""" + "".join(f"""  UNION ALL SELECT '10 categories', '{c}=' || "{c}", 'count', count(*) FROM prof GROUP BY "{c}"
""" for c in CATEGORICAL))


# ---- P: endpoint health ----------------------------------------------------------------------
METRICS = """metrics AS (SELECT ts, 'endpoint-' || (user_id % 3) AS endpoint, metric, value FROM (
    SELECT ts, user_id, 'Invocations' AS metric, CAST(1 AS DOUBLE) AS value FROM events
    UNION ALL SELECT ts, user_id, 'Invocation5XXErrors', 1 FROM events WHERE event_type = 'error'
    UNION ALL SELECT ts, user_id, 'ModelLatency', value * CAST(20000 AS DOUBLE) FROM events
    UNION ALL SELECT ts, user_id, 'CPUUtilization', least(value, 100) FROM events
    UNION ALL SELECT ts, user_id, 'MemoryUtilization', least(value * CAST(1.25 AS DOUBLE), 100)
      FROM events
    UNION ALL SELECT ts, user_id, 'DiskUtilization', least(value * CAST(0.5 AS DOUBLE), 100)
      FROM events) WHERE value IS NOT NULL)"""


def _bucket(seconds):
    return f"time_bucket(INTERVAL '{seconds} seconds', ts)"


def _window_sql(seconds, agg, where="true"):
    return f"""SELECT endpoint, metric, {_bucket(seconds)} AS start,
      {_bucket(seconds)} + INTERVAL '{seconds} seconds' AS "end", {agg} AS value
      FROM metrics WHERE {where} GROUP BY ALL"""


def _rounded(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


Q["p1_window_sum_60"] = lambda s, d: _rounded(wi.window_metric(tb.metrics_table(s, d), 60, "sum"))
S["p1_window_sum_60"] = f"WITH {METRICS} " + _window_sql(60, "round(sum(value), 6)")
Q["p1_window_avg_300"] = lambda s, d: _rounded(
    wi.window_metric(tb.metrics_table(s, d), 300, "avg")
)
S["p1_window_avg_300"] = f"WITH {METRICS} " + _window_sql(300, "round(avg(value), 6)")


def _stream_sum(s, d):
    """P1 as a stream: one pass over the events, windows the watermark has closed."""
    live = wi.window_metric(tb.endpoint_metrics(event_stream(s, d)), 300, "sum")
    return _rounded(drained(live, "p1"))


Q["p1_stream_sum_300"] = _stream_sum
S["p1_stream_sum_300"] = (
    f"WITH {METRICS} SELECT * FROM (" + _window_sql(300, "round(sum(value), 6)")
    + """) WHERE "end" <= (SELECT max(ts) FROM metrics) - INTERVAL 10 MINUTES"""
)

for _name, _sec in (("p2_window_percentiles", 3600), ("p2_window_percentiles_60", 60)):
    Q[_name] = lambda s, d, sec=_sec: wi.window_percentiles(
        tb.metrics_table(s, d, ["ModelLatency"]), period_s=sec
    ).select("endpoint", "metric", "start", "end", *[F.round(p, 4).alias(p) for p in
                                                     ("p50", "p90", "p99")])
    S[_name] = f"""WITH {METRICS} SELECT endpoint, metric, {_bucket(_sec)} AS start,
      {_bucket(_sec)} + INTERVAL '{_sec} seconds' AS "end", round(quantile_cont(value, 0.5), 4) AS p50,
      round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99
      FROM metrics WHERE metric = 'ModelLatency' GROUP BY ALL"""


def _cells_sql(live):
    closed = """WHERE "end" <= (SELECT max(ts) FROM metrics WHERE metric = 'ModelLatency')
      - INTERVAL 10 MINUTES""" if live else ""
    grow = pt.factor()
    return f"""WITH {METRICS}, cells AS (SELECT * FROM (SELECT endpoint, metric, {_bucket(60)} AS start,
        {_bucket(60)} + INTERVAL '60 seconds' AS "end", CASE WHEN value = 0 THEN 0 ELSE sign(value)
          * (ceil(ln(abs(value)) / {math.log(grow)!r}) + 10000000) END::BIGINT AS cell, count(*) AS n
      FROM metrics WHERE metric = 'ModelLatency' GROUP BY ALL) {closed}
    ), longer AS (SELECT endpoint, metric, time_bucket(INTERVAL '300 seconds', start) AS start, cell,
        sum(n) AS n FROM cells GROUP BY ALL
    ), placed AS (SELECT *, sum(n) OVER (PARTITION BY endpoint, metric, start ORDER BY cell) AS upto,
        sum(n) OVER (PARTITION BY endpoint, metric, start) AS total FROM longer
    ), middles AS (SELECT *, CASE WHEN cell = 0 THEN 0 ELSE sign(cell) * power({grow!r},
        abs(cell) - 10000000) * {2 / (grow + 1)!r} END AS v FROM placed)
    SELECT endpoint, metric, start, start + INTERVAL '300 seconds' AS "end", total::BIGINT AS n,
      round(min(v) FILTER (upto >= ceil(total * CAST(0.5 AS DOUBLE))), 4) AS p50,
      round(min(v) FILTER (upto >= ceil(total * CAST(0.9 AS DOUBLE))), 4) AS p90,
      round(min(v) FILTER (upto >= ceil(total * CAST(0.99 AS DOUBLE))), 4) AS p99
    FROM middles GROUP BY endpoint, metric, start, total"""


def _states(cells):
    """Percentiles of 300 s, merged from states of 60 s."""
    found = pt.read_states(pt.states(pt.merged_cells(cells, 300)))
    return found.select("endpoint", "metric", "start", "end", "n", *[
        F.round(p, 4).alias(p) for p in ("p50", "p90", "p99")])


Q["p2_merged_states"] = lambda s, d: _states(
    pt.percentile_cells(tb.metrics_table(s, d, ["ModelLatency"])))
S["p2_merged_states"] = _cells_sql(False)
Q["p2_merged_states_stream"] = lambda s, d: _states(drained(
    pt.percentile_cells(tb.endpoint_metrics(event_stream(s, d), ["ModelLatency"])), "p2_states"))
S["p2_merged_states_stream"] = _cells_sql(True)


def _alarm_sql(spec, tag, disc=False):
    """CTEs that end in ``t_<tag>`` with the transitions of an alarm."""
    sec = spec.period_s
    if spec.stat.startswith("p"):
        agg = f"quantile_{'disc' if disc else 'cont'}(value, {int(spec.stat[1:]) / 100})"
    else:
        agg = f"{spec.stat}(value)"
    if spec.band:
        w = "OVER (PARTITION BY endpoint ORDER BY start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
        breach = f"""coalesce(count(value) {w} >= 2 AND abs(value - avg(value) {w})
          > 2 * stddev_pop(value) {w} + 1e-9, false)"""
    else:
        op = ">" if spec.above else "<="
        breach = f"coalesce(value {op} {spec.threshold}, {str(spec.missing_breaches).lower()})"
    return f"""w_{tag} AS (SELECT endpoint, {_bucket(sec)} AS start, {agg} AS value FROM metrics
      WHERE metric = '{spec.metric}' GROUP BY ALL
    ), g_{tag} AS (SELECT endpoint, unnest(generate_series(min(start),
      (SELECT max(start) FROM w_{tag}), INTERVAL '{sec} seconds')) AS start FROM w_{tag} GROUP BY 1
    ), b_{tag} AS (SELECT endpoint, start, {breach} AS breach
      FROM g_{tag} LEFT JOIN w_{tag} USING (endpoint, start)
    ), s_{tag} AS (SELECT endpoint, start, min(breach) OVER (PARTITION BY endpoint ORDER BY start
      ROWS BETWEEN {spec.periods - 1} PRECEDING AND CURRENT ROW)
      AND row_number() OVER (PARTITION BY endpoint ORDER BY start) >= {spec.periods} AS on_now
      FROM b_{tag}
    ), t_{tag} AS (SELECT endpoint, '{spec.name}' AS alarm, start + INTERVAL '{sec} seconds' AS "at",
      CASE WHEN on_now THEN 'ALARM' ELSE 'OK' END AS state FROM (SELECT *, lag(on_now, 1, false)
      OVER (PARTITION BY endpoint ORDER BY start) AS was FROM s_{tag}) WHERE on_now <> was)"""


# Longer periods than declared: the event tables hold a few rows per hour and endpoint.
SPECS = {
    "p3_high_5xx": al.HIGH_5XX.every(4 * 3600),
    "p4_high_latency": al.HIGH_LATENCY.every(3600),
    "p5_no_invocations": al.NO_INVOCATIONS.every(300),
    "p6_high_cpu": al.HIGH_CPU.every(300),
    "p6_high_memory": al.HIGH_MEMORY.every(300),
    "p6_high_disk": al.HIGH_DISK.every(300),
    "p8_volume_anomaly": al.VOLUME_ANOMALY.every(1800),
    # the declared periods
    "p3_high_5xx_60": al.HIGH_5XX, "p4_high_latency_60": al.HIGH_LATENCY,
    "p8_volume_anomaly_300": al.VOLUME_ANOMALY,
}
# hourly periods of a daily season
SEASONAL = al.SEASONAL_ANOMALY.every(3600)
for _name, _spec in SPECS.items():
    Q[_name] = lambda s, d, spec=_spec: al.alarm_batch(
        tb.metrics_table(s, d, [spec.metric]), spec
    )
    S[_name] = f"WITH {METRICS}, {_alarm_sql(_spec, 'a')} SELECT * FROM t_a"

_PARTS = ["p3_high_5xx", "p4_high_latency", "p5_no_invocations", "p6_high_memory"]
_UNION = union_all(f"SELECT * FROM t_{i}" for i in range(len(_PARTS)))


def _composite(s, d):
    return al.composite_batch(stats.union_results(
        al.alarm_batch(tb.metrics_table(s, d, [SPECS[p].metric]), SPECS[p]) for p in _PARTS
    ))


Q["p7_composite"] = _composite
S["p7_composite"] = f"WITH {METRICS}, " + ", ".join(
    _alarm_sql(SPECS[p], str(i)) for i, p in enumerate(_PARTS)
) + f""", moves AS (SELECT endpoint, "at", sum(CASE WHEN state = 'ALARM' THEN 1 ELSE -1 END) AS m
    FROM ({_UNION}) GROUP BY 1, 2
  ), lv AS (SELECT endpoint, "at", sum(m) OVER (PARTITION BY endpoint ORDER BY "at") > 0 AS on_now
    FROM moves
  ) SELECT endpoint, 'endpoint-unhealthy' AS alarm, "at",
    CASE WHEN on_now THEN 'ALARM' ELSE 'OK' END AS state FROM (SELECT *, lag(on_now, 1, false)
    OVER (PARTITION BY endpoint ORDER BY "at") AS was FROM lv) WHERE on_now <> was"""


_DECLARED = ["p3_high_5xx_60", "p4_high_latency_60", "p5_no_invocations", "p6_high_memory"]
Q["p7_composite_declared"] = lambda s, d: al.composite_batch(stats.union_results(
    al.alarm_batch(tb.metrics_table(s, d, [SPECS[p].metric]), SPECS[p]) for p in _DECLARED))
S["p7_composite_declared"] = S["p7_composite"]
for _i, _name in enumerate(_DECLARED):
    S["p7_composite_declared"] = S["p7_composite_declared"].replace(
        _alarm_sql(SPECS[_PARTS[_i]], str(_i)), _alarm_sql(SPECS[_name], str(_i)))


def _alarm_live(name):
    def run(s, d):
        live = al.alarm_stream(
            tb.endpoint_metrics(event_stream(s, d), [SPECS[name].metric]), SPECS[name]
        )
        return drained(live, name)
    return run


for _name in ("p4_high_latency", "p5_no_invocations", "p8_volume_anomaly"):
    _spec = SPECS[_name]
    Q[f"{_name}_stream"] = _alarm_live(_name)
    S[f"{_name}_stream"] = f"""WITH {METRICS}, {_alarm_sql(_spec, 'a', disc=True)}
      SELECT * FROM t_a WHERE "at" <= (SELECT max(ts) FROM metrics WHERE metric = '{_spec.metric}')
        - INTERVAL 10 MINUTES"""

Q["p8_seasonal_anomaly"] = lambda s, d: al.alarm_batch(
    tb.metrics_table(s, d, ["Invocations"]), SEASONAL)


def _seasonal_twins(s, d):
    """Batch and stream agree on every single breach of the seasonal band."""
    spec = replace(SEASONAL, periods=1)
    metrics = tb.metrics_table(s, d, ["Invocations"])
    seen = metrics.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=10)
    live = drained(al.alarm_stream(tb.endpoint_metrics(event_stream(s, d), ["Invocations"]), spec),
                   "p8_seasonal").collect()
    batch = al.alarm_batch(metrics, spec).where(F.col("at") <= F.lit(seen)).collect()
    windows = wi.alarm_windows(metrics, spec)
    return al.period_grid(windows, 3600).groupBy("endpoint").agg(F.count("*").alias("periods")).withColumn(
        "agree", F.lit(bool(batch) and sorted(map(str, live)) == sorted(map(str, batch))))


Q["p8_seasonal_twins"] = _seasonal_twins
S["p8_seasonal_twins"] = f"""WITH {METRICS}, w AS (SELECT endpoint, {_bucket(3600)} AS start FROM metrics
    WHERE metric = 'Invocations') SELECT endpoint, 1 + (epoch((SELECT max(start) FROM w))
    - epoch(min(start)))::BIGINT // 3600 AS periods, true AS agree FROM w GROUP BY endpoint"""

_SLOT = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"
_EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "date"]
Q["p9_capture"] = lambda s, d: cp.capture(tb.table(s, d, "events"), 20, "event_id").select(
    *_EVENT_COLS
)
S["p9_capture"] = f"""SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date
  FROM events WHERE {_SLOT}"""
Q["p9_capture_stream"] = lambda s, d: drained(
    cp.capture(event_stream(s, d), 20, "event_id"), "capture", ["date"]
).select(*_EVENT_COLS)
S["p9_capture_stream"] = S["p9_capture"]


def _rule_stream(s, d):
    """P10: hybrid scoring of a customer stream; the closed-form score stands in for a model."""
    path = sk.fresh_path(s, "customers")
    profile = tb.customer_profile(s, d)
    profile.write.parquet(path)
    rules = ru.fit_rules(s.read.parquet(path))

    class ClosedForm:
        def score(self, df):
            p = tb.closed_form_score(digits=None)
            return df.withColumns({"p": p, "prediction": (p > 0.5).cast("int")})

    live = s.readStream.schema(profile.schema).parquet(path)
    hybrid = tr.Hybrid(rules, ClosedForm())
    out = drained(cp.score_stream(live, hybrid, NOW), "scored")
    return out.drop("timestamp")


_RAW = SCORE.format(lift="0.0")[len("round("):-len(", 6)")]
Q["p10_score_stream"] = _rule_stream
S["p10_score_stream"] = prof(
    f"""SELECT 'customer_' || "CustomerID" AS customer_id,
    CASE WHEN det THEN 1 ELSE CAST(raw > 0.5 AS INTEGER) END AS churn_prediction,
    round(prob, 4) AS churn_probability, round(1.0 - prob, 4) AS retention_probability,
    CASE WHEN prob >= 0.7 THEN 'HIGH' WHEN prob >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN det THEN 'rules' ELSE 'ml' END AS prediction_source
    FROM (SELECT *, CASE WHEN det THEN 1.0 ELSE raw END AS prob FROM (
      SELECT *, {any_rule("(SELECT q20 FROM spend)")} AS det, {_RAW} AS raw FROM prof))""", LIMIT,
)

QUERIES, ORACLES = Q, S
