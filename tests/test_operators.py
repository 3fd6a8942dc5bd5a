import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions import features as fe
from holdfast.operators import clean, joins, prep, profile as pr, rank, rules, split, stats
from holdfast.operators import metrics as mx
from holdfast.operators import quantiles as qs
from holdfast.operators.ordering import hash_rank
from holdfast.schema import CATEGORICAL, NUMERIC
from conftest import customers


# ---- features --------------------------------------------------------------------------------
def test_bin_edges_are_right_closed(spark):
    df = spark.createDataFrame(
        [(0, 0), (6, 25), (7, 26), (12, 35), (24, 45), (36, 55), (61, 100), (62, 101),
         (None, None)], "Tenure int, Age int",
    )
    rows = df.select(fe.tenure_bucket().alias("t"), fe.age_group().alias("a")).collect()
    assert [r["t"] for r in rows] == [0, 0, 1, 1, 2, 3, 4, None, None]
    assert [r["a"] for r in rows] == [0, 0, 1, 1, 2, 3, 4, None, None]


def test_flags_are_zero_on_null(spark):
    df = spark.createDataFrame([(None,)], "`Support Calls` int")
    assert df.select(fe.is_high_support().alias("x")).first()["x"] == 0


def test_feature_sets_have_the_right_width(three):
    assert len(fe.engineer_v1(three).columns) == 12 + 15
    assert len(fe.engineer_v2(three).columns) == 12 + 9


def test_qcut_rejects_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    with pytest.raises(ValueError):
        stats.qcut(df, "x", 5)


# ---- quantiles -------------------------------------------------------------------------------
@pytest.mark.parametrize("values", [
    [float(x) for x in range(1, 1001)],
    [5.0] * 600 + [float(x) for x in range(400)],
    [1.0, 2.0, 4.0, 8.0],
    [3.0],
    [1e-300, 1e300, -1e308, 0.0, 1e308] * 9,
    [0.1 + 0.2, 0.3] * 40,
    [-1.5, -1.5, 0.0, 2.25, 2.25, 2.25, 9.0] * 40,
])
def test_bracketed_quantiles_are_exact(spark, values):
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0]
    wanted = np.quantile(values, probs)
    for limit in (10**6, 20, 0):
        got = qs.quantiles(df, {"x": F.col("x")}, probs, limit)["x"]
        assert np.allclose(got, wanted, rtol=1e-12)


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert qs.quantile(df, "x", 0.5) == 2.0
    assert qs.quantile(df.filter("x is null"), "x", 0.5) is None


# ---- profile and cleaning --------------------------------------------------------------------
def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None)], "x double, s string")
    assert {r["column"]: r["n_null"] for r in pr.null_counts(df).collect()} == {"x": 1, "s": 1}
    assert clean.nan_to_null(df).filter("x is null").count() == 1


def test_target_by_name(three):
    assert pr.find_target(three) == "Churn"
    assert pr.find_target(three.drop("Churn")) is None
    with pytest.raises(ValueError):
        clean.split_xy(three.drop("Churn"))


def test_high_band_leaves_out_the_largest(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)], "x double")
    assert clean.in_range(df, "x", 0.75, 1.0).count() == 1


# ---- preprocessing ---------------------------------------------------------------------------
def test_drop_first_encoding_has_twelve_columns(three):
    x = three.drop("CustomerID", "Churn")
    hot = prep.one_hot(x, CATEGORICAL, drop="first")
    assert len(hot.transform(x).columns) == 7 + 5


def test_population_scaling(three):
    cols = ["Age", "Tenure", "Total Spend"]
    out = prep.standard_scaler(three, cols).transform(three).toPandas()[cols]
    assert np.abs(out.to_numpy().mean()) < 1e-9
    assert np.abs(out.to_numpy().std() - 1) < 1e-9


def test_constant_column_keeps_its_scale(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in prep.standard_scaler(df, ["x"]).transform(df).collect()] == [0.0, 0.0]


def test_median_of_an_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "x double")
    assert prep.median_imputer(df, ["x"]).fill == {"x": 3.0}


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert prep.mode_imputer(df, ["s"]).fill == {"s": "a"}


def test_unknown_category_fails_or_gives_zeros(spark):
    fit = prep.one_hot(spark.createDataFrame([("a",), ("b",)], "s string"), ["s"], drop="first")
    new = spark.createDataFrame([("z",)], "s string")
    assert fit.transform(new).first()["s_b"] == 0
    fit.unknown = "error"
    with pytest.raises(Exception, match="unknown category"):
        fit.transform(new).collect()


def test_widths_of_both_pipelines(spark):
    df = spark.createDataFrame(customers(300))
    for engineer, rows, width in [(fe.engineer_v1, df, 30), (
        fe.engineer_v2, df.filter("`Contract Length` <> 'Monthly'"), 23
    )]:
        data = engineer(rows)
        numeric, categorical = clean.feature_lists(data)
        assert len(prep.build_preprocessor(data, numeric, categorical).feature_names) == width


def test_quotes_in_categories(spark):
    df = spark.createDataFrame([(1.0, "it's"), (2.0, "b\\c")], "x double, s string")
    pre = prep.build_preprocessor(df, ["x"], ["s"])
    got = [list(r["features"].toArray()) for r in pre.transform(df).orderBy("x").collect()]
    assert got == [[-1.0, 0.0, 1.0], [1.0, 1.0, 0.0]]


# ---- splits ----------------------------------------------------------------------------------
def test_split_is_exact_and_independent_of_partitions(spark):
    df = spark.createDataFrame(customers(333))
    one = split.stratified_split(df.coalesce(1), "Churn")
    many = split.stratified_split(df.repartition(17), "Churn")
    a = {r["CustomerID"]: r["is_train"] for r in one.collect()}
    b = {r["CustomerID"]: r["is_train"] for r in many.collect()}
    assert a == b
    for r in one.groupBy("Churn").agg(F.count("*").alias("n"),
                                      F.count_if("is_train").alias("t")).collect():
        assert r["t"] == math.floor(0.8 * r["n"] + 0.5)


def test_sample_keeps_class_shares(spark):
    df = spark.createDataFrame(customers(200))
    sample = split.stratified_sample(df, "Churn", 50)
    assert sample.count() == 50
    assert split.stratified_sample(df, "Churn", 5000).count() == 200
    assert split.class_quotas({0: 7, 1: 3}, 5) == {0: 4, 1: 1}
    assert sum(split.class_quotas({0: 1, 1: 1, 2: 1}, 2).values()) == 2


def test_folds_are_disjoint_and_balanced(spark):
    df = split.add_folds(spark.createDataFrame(customers(101)), "Churn", 5)
    assert df.select("CustomerID").distinct().count() == 101
    sizes = df.groupBy("Churn", "fold").count().toPandas()
    for _, g in sizes.groupby("Churn"):
        assert g["count"].max() - g["count"].min() <= 1


def test_hash_rank_counts_every_row_once(spark):
    df = hash_rank(spark.range(1000).withColumnRenamed("id", "k"), "k", 1)
    assert sorted(r["rank"] for r in df.collect()) == list(range(1, 1001))


def test_permuted_labels_keep_their_counts(spark):
    df = spark.createDataFrame(customers(150))
    out = split.shuffle_labels(df, "Churn")
    assert out.count() == 150
    assert out.agg(F.sum("shuffled")).first()[0] == df.agg(F.sum("Churn")).first()[0]
    assert out.filter("shuffled <> Churn").count() > 0


# ---- joins -----------------------------------------------------------------------------------
def test_overlap_multiplies_copies_and_matches_missing(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (nan, None), (2.0, "y")], "v double, s string")
    b = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (1.0, "x"), (None, None)],
                              "v double, s string")
    assert joins.overlap(a, b).first()["overlapping"] == 2 * 3 + 1
    assert joins.overlap(a, b.filter("v > 5")).first()["overlapping"] == 0


def test_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    dim = spark.createDataFrame([("a", 2.0)], "k string, w double")
    got = {r["k"]: r["w"] for r in joins.lookup(df, dim, "k", "w", 0.01).collect()}
    assert got == {"a": 2.0, "b": 0.01, None: 0.01}


# ---- rules -----------------------------------------------------------------------------------
def test_missing_values_fire_no_rule(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), (6, "Annual", 0, 1000.0), (2, "Annual", 5, 405.0)],
        "`Support Calls` int, `Contract Length` string, `Payment Delay` int, `Total Spend` double",
    )
    hits = [r[0] for r in df.select(rules.churn_rules().mask()).collect()]
    assert hits == [False, True, True]


def test_risk_levels(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.39,)], "p double")
    assert [r[0] for r in df.select(rules.risk_level(F.col("p"))).collect()] == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW"
    ]


def test_rule_that_never_fires_has_rate_zero(spark):
    df = spark.createDataFrame([(1, 0)], "x int, Churn int")
    out = rules.rule_analysis(df, rules.RuleSet([("never", F.col("x") > 5)])).collect()
    assert [(r["count"], r["churn_rate"]) for r in out] == [(0, 0.0), (0, 0.0)]


# ---- metrics ---------------------------------------------------------------------------------
def brute(labels, p):
    """Areas by comparing all pairs and walking the ranked list."""
    pos = [s for y, s in zip(labels, p) if y]
    neg = [s for y, s in zip(labels, p) if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp = sum(y for y, s in zip(labels, p) if s >= t)
        n = sum(s >= t for s in p)
        ap += (tp - seen) / len(pos) * tp / n
        seen = tp
    return auc, ap


@pytest.mark.parametrize("hot", [0, 400])
def test_areas_equal_brute_force(spark, hot):
    rng = random.Random(3)
    labels = [int(rng.random() < 0.4) for _ in range(600)]
    p = [round(rng.random(), 2) for _ in labels]
    p[:hot] = [1.0] * hot                     # one score holds most of the rows
    df = spark.createDataFrame(list(zip(labels, p)), "label int, p double")
    auc, ap = brute(labels, p)
    assert mx.roc_auc(df).first()[0] == pytest.approx(auc, abs=1e-6)
    assert mx.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-6)
    assert mx.roc_auc(df, splits=[]).first()[0] == pytest.approx(auc, abs=1e-6)


def test_step_average_precision_on_six_rows(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    df = spark.createDataFrame(rows, "label int, p double")
    wanted = (1 + 2 / 3 + 3 / 6) / 3
    assert mx.average_precision(df).first()[0] == pytest.approx(wanted, abs=1e-6)


def test_empty_denominators_give_zero(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (0, 0, 0.1)], "label int, prediction int, p double")
    m = mx.metric_bundle(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["matthews_corrcoef"]) == (0, 0, 0, 0)


def test_certain_and_wrong_stays_finite(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "label int, p double")
    assert mx.log_loss(df).first()[0] == pytest.approx(36.04, abs=0.01)


def test_curve_ends(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, p double")
    roc = {(r["fpr"], r["tpr"]) for r in rank.roc_points(df).collect()}
    assert roc == {(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)}


# ---- ranking ---------------------------------------------------------------------------------
def test_top_factors_and_zeros(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.5), (1, "b", -2.0), (1, "c", 0.0), (1, "d", 0.7)],
        "row_id int, feature string, contribution double",
    )
    got = {(r["feature"], r["direction"], r["rank"]) for r in rank.top_factors(df, 1).collect()}
    assert got == {("d", "positive", 1), ("b", "negative", 1)}
    both = rank.top_factors(df, 5, zero_is_negative=True)
    assert both.filter("direction = 'negative'").count() == 2


def test_first_row_wins_ties(spark):
    df = spark.createDataFrame([("b", 0, 0.9), ("a", 1, 0.9)], "model string, i int, f1 double")
    assert rank.best_by(df, "f1", order="i").first()["model"] == "b"


def test_profile_columns(three):
    pdf = pr.column_profile(three).toPandas().set_index("column")
    assert pdf.loc["Gender", "n_unique"] == 2 and pdf["n_null"].sum() == 0
    assert isinstance(pdf, pd.DataFrame) and set(NUMERIC) <= set(pdf.index)


def test_nan_behaves_like_a_missing_value(spark):
    from holdfast.operators import validate as va

    nan = float("nan")
    df = spark.createDataFrame([("a", nan, nan), ("b", 30.0, 1.0)],
                               "CustomerID string, `Payment Delay` double, Churn double")
    rule = rules.RuleSet([("late", F.col("`Payment Delay`") > 20)])
    assert [r["x"] for r in rules.rule_mask(df, rule, "x").orderBy("CustomerID").collect()] == [
        False, True
    ]
    found = {r["check_name"]: r["status"] for r in va.check_bounds(df).collect()}
    assert found == {"bounds_check_Payment Delay": "passed"}
