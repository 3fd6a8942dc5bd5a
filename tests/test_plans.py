import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.functions.features import engineer_v2
from holdfast.operators import explain, rules as ru
from holdfast.operators.prep import build_preprocessor
from holdfast.operators.split import add_folds
from holdfast.plans import attribution as at, diagnose as dg, models as md, results as res
from holdfast.plans import scoring as sg, train as tr, tuning as tu
from holdfast.sources.tables import planted_profile
from conftest import customers


@pytest.fixture(scope="module")
def pattern(spark):
    """500 rows whose label is x0 + x1 > 0."""
    rng = np.random.default_rng(42)
    x = rng.standard_normal((500, 5))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(5)])
    pdf["CustomerID"] = [f"r{i}" for i in range(500)]
    pdf["Churn"] = (x[:, 0] + x[:, 1] > 0).astype(int)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def planted(spark):
    return planted_profile(spark.createDataFrame(customers(400)), 5.0).cache()


def pre_of(df):
    return build_preprocessor(df, [f"x{i}" for i in range(5)], [])


@pytest.mark.parametrize("algorithm, params", [
    ("random_forest", {"numTrees": 10, "maxDepth": 5}), ("xgboost", {"maxIter": 8}),
    ("logistic_regression", {}), ("svm", {"maxIter": 20}),
])
def test_models_learn_a_pattern(pattern, algorithm, params):
    train, test = pattern.filter("hash(CustomerID) % 5 <> 0"), pattern.filter(
        "hash(CustomerID) % 5 = 0")
    fitted = md.fit_pipeline(train, md.make_model(algorithm, params), algorithm, pre=pre_of(train))
    scored = fitted.score(test).toPandas()
    assert len(scored) == test.count()
    assert set(scored["prediction"]) <= {0, 1}
    assert scored["p"].between(0, 1).all()
    assert np.allclose(scored["confidence"], np.maximum(scored["p"], 1 - scored["p"]))
    assert (scored["prediction"] == scored["Churn"]).mean() > 0.6


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        md.make_model("kernel_magic")


def test_saved_model_scores_the_same(spark, pattern, tmp_path):
    fitted = md.fit_pipeline(pattern, md.tree(), "tree", pre=pre_of(pattern))
    md.save_model(fitted, str(tmp_path / "m"), 1.5)
    loaded, limit = md.load_model(spark, str(tmp_path / "m"))
    assert limit == 1.5 and loaded.feature_names == fitted.feature_names
    a = fitted.score(pattern).select("CustomerID", "p").toPandas().set_index("CustomerID")
    b = loaded.score(pattern).select("CustomerID", "p").toPandas().set_index("CustomerID")
    assert a["p"].equals(b["p"].loc[a.index])


def test_importance_finds_the_two_features(pattern):
    fitted = md.fit_pipeline(pattern, md.rf(numTrees=20, maxDepth=5), "rf", pre=pre_of(pattern))
    top = [f for f, _ in md.importance_rows(fitted)[:2]]
    assert set(top) == {"x0", "x1"}


def test_class_weights_sum_to_the_row_count(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "Churn int")
    rows = {r["value"]: r["weight"] for r in md.class_weights(df).collect()}
    assert rows == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    assert md.with_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(8.0)


def test_draws_are_seeded_and_in_range():
    a, b = tu.draw(tu.RANGES["xgboost"], 20), tu.draw(tu.RANGES["xgboost"], 20)
    assert a == b
    assert all(0.01 <= d["stepSize"] <= 0.3 and 3 <= d["maxDepth"] <= 12 for d in a)


def test_out_of_fold_scores_cover_every_row_once(pattern):
    pre = pre_of(pattern)
    data = md.prepared(pre, add_folds(pattern, "Churn", 3), keep=["fold", "CustomerID"]).cache()
    scored = tr.out_of_fold(data, {"t": md.tree(maxDepth=3)}, 3)
    assert scored.count() == 500 and scored.select("CustomerID").distinct().count() == 500
    assert scored.agg(F.avg(((F.col("_p_t") > 0.5) == (F.col("label") == 1)).cast("int"))
                      ).first()[0] > 0.6


def test_ensemble_wins_ties():
    scores = {"a": {"f1": 0.5}, "s": {"f1": 0.5}}
    assert tr.choose_final(scores, "a", "s") == "s"
    scores["s"]["f1"] = 0.4
    assert tr.choose_final(scores, "a", "s") == "a"


def test_hybrid_training(spark, planted):
    grid = {"random_forest": {"numTrees": [10], "maxDepth": [4]},
            "xgboost": {"maxIter": [5], "maxDepth": [3]}}
    plan = tr.plan_v2(algorithms=("random_forest", "xgboost"), grids=grid, n_iter=1, tune_folds=2,
                      stack_folds=2)
    out = tr.train_v2(planted, plan)
    assert out.final_name in out.metrics and "StackingEnsemble" in out.metrics
    assert out.hybrid_metrics["recall"] > 0.5
    assert out.importance and out.trials.count() == 2
    scored = out.hybrid.score(planted)
    assert scored.count() == 400
    decided = scored.filter(out.hybrid.rules.mask())
    assert decided.filter("p = 1.0 AND prediction = 1 AND prediction_source = 'rules'"
                          ).count() == decided.count()
    assert scored.filter(~out.hybrid.rules.mask()).filter("prediction_source <> 'ml'").count() == 0
    batch = sg.score_batch(planted, out.hybrid, "2024-01-01 00:00:00")
    row = batch.first()
    assert row["customer_id"].startswith("customer_")
    assert row["churn_probability"] + row["retention_probability"] == pytest.approx(1, abs=2e-4)


def test_model_branch_filters_before_the_model(spark, planted):
    rules = ru.churn_rules()
    fitted = md.fit_pipeline(engineer_v2(planted.filter(~rules.mask())), md.tree(), "tree")
    plan = tr.Hybrid(rules, fitted).score(planted)._jdf.queryExecution().optimizedPlan().toString()
    model_branch = plan[plan.index("UDF"):]
    assert "Filter" in model_branch and "NOT coalesce" in model_branch


# ---- diagnostics -----------------------------------------------------------------------------
def test_shuffled_labels_cannot_be_learned(planted):
    small = {"numTrees": 10, "maxDepth": 4}
    raw, top, _ = dg.baseline(planted, small)
    shuffled = dg.shuffled_target_test(planted, small)
    assert raw["accuracy"] > 0.8 and top.count() == 12
    assert shuffled["accuracy"] < raw["accuracy"]


def test_single_features(planted):
    power = {r["feature"]: r["f1"] for r in dg.single_feature_power(planted).collect()}
    assert power["Payment Delay"] > power["Age"]


# ---- attributions ----------------------------------------------------------------------------
def exact_shapley(f, x, base):
    n = len(x)
    phi = [0.0] * n
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                without = [x[i] if i in s else base[i] for i in range(n)]
                with_j = [x[i] if i in s or i == j else base[i] for i in range(n)]
                phi[j] += weight * (f(with_j) - f(without))
    return phi


def test_sampled_attributions_approach_the_exact_ones(spark):
    rows = [("r1", 2.0, 3.0, -1.0), ("r2", -1.0, 0.5, 4.0)]
    df = spark.createDataFrame(rows, "CustomerID string, a double, b double, c double")
    back = spark.createDataFrame([("z", 0.5, 1.0, 0.0)], df.schema)

    def score(x):
        return x.withColumn("p", F.col("a") * F.col("b") + F.col("c"))

    got = at.shap_sampled(df, score, back, ["a", "b", "c"], n_perm=300)
    found = {(r["row_id"], r["feature"]): r["shap"] for r in got.collect()}
    for rid, *x in rows:
        phi = exact_shapley(lambda v: v[0] * v[1] + v[2], x, [0.5, 1.0, 0.0])
        assert found[rid, "(base)"] == pytest.approx(0.5)
        assert sum(found[rid, n] for n in "abc") + 0.5 == pytest.approx(x[0] * x[1] + x[2])
        for n, want in zip("abc", phi):
            assert found[rid, n] == pytest.approx(want, abs=0.35)


def test_interactions_see_the_product(spark):
    df = spark.createDataFrame([("r1", 2.0, 3.0, -1.0)], "CustomerID string, a double, b double, "
                               "c double")
    back = spark.createDataFrame([("z", 0.5, 1.0, 0.0)], df.schema)

    def score(x):
        return x.withColumn("p", F.col("a") * F.col("b") + F.col("c"))

    got = {(r[0], r[1]): r[2] for r in at.interactions(df, score, back, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx((2.0 - 0.5) * (3.0 - 1.0))
    assert got[("a", "c")] == pytest.approx(0) and got[("b", "c")] == pytest.approx(0)


def test_linear_attributions_add_up(three):
    coef = {"Age": 0.5, "Tenure": -1.0}
    means = explain.background_means(three, list(coef))
    base = explain.linear_base(coef, 0.1, means)
    total = explain.shap_linear(three, coef, means, "CustomerID").groupBy("row_id").agg(
        F.sum("shap").alias("s")).orderBy("row_id").collect()
    values = three.orderBy("CustomerID").select("Age", "Tenure").collect()
    for r, (age, tenure) in zip(total, values):
        assert r["s"] + base == pytest.approx(0.1 + 0.5 * age - tenure)


def test_factors_inside_the_row_equal_the_ranked_long_table(spark, three):
    from holdfast.operators.rank import top_factors

    coef = {"Age": 0.5, "Tenure": -1.0, "Support Calls": 0.2}
    means = {"Age": 30.0, "Tenure": 24.0, "Support Calls": 3.0}
    wide = explain.with_factors(three, explain.linear_entries(coef, means), 2)
    got = {(r["CustomerID"], f["feature"], f["rank"]) for r in wide.collect()
           for f in (*r["churn_factors"], *r["retention_factors"])}
    long = explain.shap_linear(three, coef, means, "CustomerID")
    want = {(r["row_id"], r["feature"], r["rank"])
            for r in top_factors(long, 2, value="shap").collect()}
    assert got == want and len(got) > 4
    packed = explain.with_factors(explain.long_entries(long), F.col("entries"), 2)
    assert {(r["row_id"], f["feature"], f["rank"]) for r in packed.collect()
            for f in (*r["churn_factors"], *r["retention_factors"])} == want


def test_model_card(spark):
    metrics = spark.createDataFrame([(0.9, 0.8)], "accuracy double, roc_auc double").withColumns({
        "precision": F.lit(None).cast("double"), "recall": F.lit(0.5), "f1": F.lit(0.6)})
    imp = spark.createDataFrame([("a", 0.25)], "feature string, mean_abs_shap double")
    lines = [r["text"] for r in res.model_card(metrics, imp, "RF", 30, "2024-01-01 00:00:00")
             .orderBy("line").collect()]
    assert "- **Accuracy**: 0.9" in lines and "- **Precision**: N/A" in lines
    assert "1. **a**: 0.2500" in lines


def _newton(x, y, w, c):
    """Coefficient and intercept of the summed, weighted loss plus ridge 1 / (2 C)."""
    b = np.zeros(2)
    m = np.column_stack([x, np.ones_like(x)])
    ridge = np.diag([1 / c, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-m @ b))
        grad = m.T @ (w * (p - y)) + ridge @ b
        hess = (m * (w * p * (1 - p))[:, None]).T @ m + ridge
        b = b - np.linalg.solve(hess, grad)
    return b


@pytest.mark.parametrize("c, column", [(1.0, None), (0.01, None), (0.1, "w_balanced"),
                                       (0.5, "w_positive_6")])
def test_regularisation_and_weights_of_logistic_regression(spark, c, column):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    y = (x + rng.normal(size=80) > 0.7).astype(float)
    w = {None: np.ones(80), "w_balanced": 80 / (2 * np.where(y == 1, y.sum(), 80 - y.sum())),
         "w_positive_6": np.where(y == 1, 6.0, 1.0)}[column]
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, label double"))
    est = md.logreg(c, tol=1e-10, **({"weightCol": column} if column else {}))
    assert md.weight_of(est) == ([column] if column else [])
    model = est.fit(md.weight_columns(data, md.weight_of(est)))
    want = _newton(x, y, w, c)
    assert model.coefficients[0] == pytest.approx(want[0], rel=1e-3)
    assert model.intercept == pytest.approx(want[1], rel=1e-3, abs=1e-3)


def test_weight_columns_of_a_search(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", float(v), int(v > 1.0)) for i, v in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "CustomerID string, x double, Churn int")
    pre = build_preprocessor(df, ["x"], [])
    space = {"maxDepth": [2], "weightCol": ["w_balanced", "w_none", "w_unbalanced"]}
    best, _, trials = tu.random_search(df, "decision_tree", space, 4, 2, pre)
    assert best["weightCol"] in space["weightCol"]
    assert {r["status"] for r in trials.collect()} == {"Completed"}
    fitted = md.fit_pipeline(df, md.make_model("decision_tree", best), "tree", pre=pre)
    assert fitted.score(df).count() == 200
