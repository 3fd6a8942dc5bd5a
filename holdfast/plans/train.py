"""Training jobs: tune, refit, stack, choose, combine with the rules."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.features import engineer_v1, engineer_v2
from holdfast.operators import metrics as mx
from holdfast.operators.clean import clean_v1, clean_v2, feature_lists
from holdfast.operators.prep import Preprocessor, build_preprocessor
from holdfast.operators.profile import nan_to_null
from holdfast.operators.rules import RuleSet, churn_rules, fit_threshold
from holdfast.operators.split import add_folds, stratified_sample, stratified_split
from holdfast.plans.models import (
    Fitted, fit_pipeline, importance_rows, logreg, make_model, prepared, weight_columns, weight_of,
    with_weights,
)
from holdfast.plans.tuning import GRIDS_V1, GRIDS_V2, random_search
from holdfast.schema import ID, TARGET
from holdfast.session import shared_dir, staged

TUNING_ROWS = 50_000


def evaluate(fitted, test: DataFrame, target: str = TARGET, digits: int = 6,
             names: Sequence[str] = mx.BUNDLE) -> DataFrame:
    """Metric bundle on held-out rows. Scores are written once: the metrics read them thrice."""
    scored = fitted.score(test).select(F.col(f"`{target}`").alias("label"), "prediction", "p")
    return mx.metric_bundle(staged(scored, "scores"), digits=digits, names=names)


# ---- stacking --------------------------------------------------------------------------------
@dataclass
class Stacked:
    """Base classifiers on shared preprocessing, and the logistic model over their scores."""

    name: str
    pre: Preprocessor
    bases: list[tuple[str, Model]]
    meta: Model
    feature_names: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        out = self.pre.transform(df)
        out = _base_scores(out, self.bases)
        out = _meta_input([n for n, _ in self.bases]).transform(out)
        both = vector_to_array("probability")
        out = self.meta.transform(out).withColumns({
            "p": both[1], "confidence": F.array_max(both),
            "prediction": F.col("prediction").cast("int"),
        })
        return out.drop("features", "rawPrediction", "probability", "_meta",
                        *[f"_p_{n}" for n, _ in self.bases])

    @property
    def classifier(self):
        """First base model that knows feature importance."""
        return next((m for _, m in self.bases if hasattr(m, "featureImportances")), self.meta)


def _base_scores(df: DataFrame, bases: Sequence[tuple[str, Model]]) -> DataFrame:
    """Probability of class 1 from each base model, as one column per model."""
    for name, model in bases:
        df = (
            model.transform(df)
            .withColumn(f"_p_{name}", vector_to_array("probability")[1])
            .drop("rawPrediction", "probability", "prediction")
        )
    return df


def _meta_input(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"_p_{n}" for n in names], outputCol="_meta")


def out_of_fold(data: DataFrame, models: dict[str, Estimator], k: int) -> DataFrame:
    """Scores of every row from models that have not seen its fold.

    ``data`` has ``features``, ``label`` and ``fold``. One fit per fold and model; the scored
    folds are put together again, so no join is needed.
    """
    parts = []
    for i in range(k):
        rest = data.filter(F.col("fold") != i)
        fitted = [(n, est.fit(rest)) for n, est in models.items()]
        parts.append(_base_scores(data.filter(F.col("fold") == i), fitted))
    return reduce(DataFrame.unionByName, parts)


def stack(train: DataFrame, models: dict[str, Estimator], pre: Preprocessor, k: int = 5,
          balanced: bool = False, target: str = TARGET, id_col: str = ID,
          name: str = "StackingEnsemble", fitted: dict[str, Model] | None = None) -> Stacked:
    """Stacking: out-of-fold scores feed a logistic model.

    The bases see all rows in the end; pass them as ``fitted`` when they are trained already.
    """
    folded = add_folds(train, target, k, id_col=id_col)
    names = [w for est in models.values() for w in weight_of(est)]
    data = staged(weight_columns(prepared(pre, folded, target, keep=["fold"]), names), "stack")
    meta_rows = _meta_input(list(models)).transform(out_of_fold(data, models, k))
    meta_rows = meta_rows.select("_meta", "label")
    params = {"featuresCol": "_meta", "maxIter": 1000, "regParam": 1.0 / max(data.count(), 1),
              "standardization": False}
    if balanced:
        meta_rows = with_weights(meta_rows, "label")
        params["weightCol"] = "weight"
    meta = LogisticRegression(labelCol="label", **params).fit(meta_rows)
    bases = [(n, (fitted or {}).get(n) or est.fit(data)) for n, est in models.items()]
    return Stacked(name, pre, bases, meta, pre.feature_names)


# ---- hybrid ----------------------------------------------------------------------------------
@dataclass
class Hybrid:
    """Rules first; the model sees the rows no rule decides."""

    rules: RuleSet
    model: Fitted | Stacked
    engineer: Callable[[DataFrame], DataFrame] = engineer_v2

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, ``p`` and ``prediction_source`` to every row."""
        df = nan_to_null(df)
        cols = [F.col(f"`{c}`") for c in df.columns]
        hit = self.rules.mask()
        if not df.isStreaming:      # both branches read the written rows, not their sources again
            df = staged(df, "hybrid")
        decided = df.filter(hit).select(
            *cols, F.lit(1).alias("prediction"), F.lit(1.0).alias("p"),
            F.lit("rules").alias("prediction_source"),
        )
        open_rows = self.model.score(self.engineer(df.filter(~hit))).select(
            *cols, "prediction", "p", F.lit("ml").alias("prediction_source")
        )
        return decided.unionByName(open_rows)


# ---- whole jobs ------------------------------------------------------------------------------
@dataclass
class Plan:
    """Sizes of a training job."""

    algorithms: Sequence[str] = ("xgboost", "lightgbm", "random_forest")
    grids: dict = field(default_factory=lambda: GRIDS_V1)
    n_iter: int = 15
    tune_folds: int = 3
    stack_folds: int = 5
    tuning_rows: int = TUNING_ROWS
    parallelism: int = 4
    balanced: bool = False
    fixed: dict = field(default_factory=dict)


def plan_v1(**changes) -> Plan:
    return Plan(**changes)


def plan_v2(**changes) -> Plan:
    return Plan(**{"grids": GRIDS_V2, "n_iter": 20, "tune_folds": 5, "balanced": True, **changes})


@dataclass
class Outcome:
    """Result of a training job."""

    final_name: str
    final: Fitted | Stacked
    metrics: dict[str, dict]
    cv_f1: dict[str, float | None]
    importance: list[tuple[str, float]]
    trials: DataFrame | None
    sizes: dict[str, int]
    hybrid: Hybrid | None = None
    hybrid_metrics: dict | None = None
    rules_limit: float | None = None

    def rows(self, spark) -> DataFrame:
        """One row per model with its fold score and metrics."""
        names = list(next(iter(self.metrics.values())))
        data = [
            (m, self.cv_f1.get(m), m == self.final_name, *[v[n] for n in names])
            for m, v in self.metrics.items()
        ]
        schema = "model string, cv_f1 double, chosen boolean, " + ", ".join(
            f"{n} double" for n in names
        )
        return spark.createDataFrame(data, schema)


def _train(train: DataFrame, test: DataFrame, plan: Plan, target: str, id_col: str) -> Outcome:
    """Tune on a sample, refit on all training rows, stack, and keep the better one by F1."""
    numeric, categorical = feature_lists(train, target, drop=(id_col, "is_train"))
    sample = staged(stratified_sample(train, target, plan.tuning_rows, id_col=id_col), "tuning")
    pre_sample = build_preprocessor(sample, numeric, categorical)
    pre = build_preprocessor(train, numeric, categorical)
    estimators, cv_f1, trials = {}, {}, []
    for algorithm in plan.algorithms:
        fixed = plan.fixed.get(algorithm, {})
        best, score, table = random_search(
            sample, algorithm, plan.grids[algorithm], plan.n_iter, plan.tune_folds, pre_sample,
            target, id_col, parallelism=plan.parallelism, fixed=fixed,
        )
        estimators[algorithm] = make_model(algorithm, {**fixed, **best})
        cv_f1[algorithm] = score
        trials.append(table.withColumn("algorithm", F.lit(algorithm)))
    fitted = {n: fit_pipeline(train, est, n, target, pre) for n, est in estimators.items()}
    scores = {n: evaluate(f, test, target).first().asDict() for n, f in fitted.items()}
    best_name = max(scores, key=lambda n: scores[n]["f1"])
    final = fitted[best_name]
    if len(estimators) >= 2:
        stacked = stack(train, estimators, pre, plan.stack_folds, plan.balanced, target, id_col,
                        fitted={n: f.classifier for n, f in fitted.items()})
        scores[stacked.name] = evaluate(stacked, test, target).first().asDict()
        cv_f1[stacked.name] = None
        if choose_final(scores, best_name, stacked.name) == stacked.name:
            final = stacked
    return Outcome(
        final.name, final, scores, cv_f1, importance_rows(final),
        reduce(DataFrame.unionByName, trials),
        {"train_rows": train.count(), "test_rows": test.count(),
         "n_features": len(numeric) + len(categorical)},
    )


def choose_final(scores: dict[str, dict], single: str, ensemble: str) -> str:
    """The ensemble when its F1 is at least that of the best single model."""
    return ensemble if scores[ensemble]["f1"] >= scores[single]["f1"] else single


def choose_final_rows(scores: DataFrame, ensemble: str, metric: str = "f1") -> DataFrame:
    """The winning row of a result table; the ensemble wins ties."""
    return scores.orderBy(
        F.desc(metric), F.desc(F.col("model") == ensemble), F.asc("model")
    ).limit(1)


def _split(df: DataFrame, target: str, id_col: str, name: str):
    """Write the table once, then mark the training rows; the mark compares hashes in place."""
    marked = stratified_split(staged(df, name), target, 0.8, id_col=id_col)
    rest = marked.filter("NOT is_train").drop("is_train")
    return marked, marked.filter("is_train").drop("is_train"), rest


def train_v1(df: DataFrame, plan: Plan | None = None, target: str = TARGET,
             id_col: str = ID) -> Outcome:
    """All rows with a label, the wide feature set, no rules."""
    shared_dir(df.sparkSession)
    data = engineer_v1(clean_v1(df, target))
    _, train, test = _split(data, target, id_col, "v1")
    return _train(train, test, plan or plan_v1(), target, id_col)


def train_v2(df: DataFrame, plan: Plan | None = None, target: str = TARGET, id_col: str = ID,
             reference_split: bool = False) -> Outcome:
    """Rules for the sure rows, a model for the rest, and metrics of both together.

    By default one split is drawn before anything is fitted, and the spend limit is learned on its
    training rows. ``reference_split`` fits the limit on all rows and draws the hold-out of the
    hybrid independently, which lets rows the model has seen into its test.
    """
    shared_dir(df.sparkSession)
    clean = clean_v2(df, target)
    marked, train_all, test_all = _split(clean, target, id_col, "v2")
    limit = fit_threshold(marked if reference_split else train_all)
    rules = churn_rules(limit)
    if reference_split:
        open_rows = marked.drop("is_train").filter(~rules.mask())
        _, train, test = _split(engineer_v2(open_rows), target, id_col, "v2-open")
        held_out = stratified_split(
            marked.drop("is_train"), target, 0.8, seed=7, id_col=id_col
        ).filter("NOT is_train").drop("is_train")
    else:
        train = engineer_v2(train_all.filter(~rules.mask()))
        test = engineer_v2(test_all.filter(~rules.mask()))
        held_out = test_all
    out = _train(train, test, plan or plan_v2(), target, id_col)
    out.hybrid, out.rules_limit = Hybrid(rules, out.final), limit
    out.hybrid_metrics = evaluate(
        out.hybrid, held_out, target, names=mx.HYBRID_BUNDLE
    ).first().asDict()
    return out


# ---- smaller jobs ----------------------------------------------------------------------------
def train_eval(df: DataFrame, algorithm: str = "random_forest", params: dict | None = None,
               target: str = TARGET, id_col: str = ID) -> tuple[Fitted, DataFrame]:
    """Split, train one configuration, and report validation accuracy and AUC."""
    _, train, test = _split(df, target, id_col, "eval")
    fitted = fit_pipeline(train, make_model(algorithm, params), algorithm, target)
    return fitted, evaluate(fitted, test, target, names=["accuracy", "roc_auc"])


SUITE = ("logistic_regression", "random_forest", "gradient_boosting", "svm")


def compare_models(df: DataFrame, algorithms: Sequence[str] = SUITE, folds: int = 5,
                   params: dict | None = None, target: str = TARGET, id_col: str = ID):
    """Every model with cross-validated AUC, hold-out metrics and training time."""
    params = params or {}
    _, train, test = _split(df, target, id_col, "compare")
    numeric, categorical = feature_lists(train, target, drop=(id_col,))
    pre = build_preprocessor(train, numeric, categorical, drop="first")
    data = staged(
        prepared(pre, add_folds(train, target, folds, id_col=id_col), target, keep=["fold"]),
        "folds",
    )
    rows, models = [], {}
    for name in algorithms:
        started = time.monotonic()
        scores = []
        for i in range(folds):
            model = make_model(name, params.get(name)).fit(data.filter(F.col("fold") != i))
            scored = model.transform(data.filter(F.col("fold") == i)).select(
                "label", vector_to_array("probability")[1].alias("p")
            )
            scores.append(mx.roc_auc(staged(scored, "scores")).first()["roc_auc"])
        fitted = fit_pipeline(train, make_model(name, params.get(name)), name, target, pre)
        seconds = time.monotonic() - started
        m = evaluate(fitted, test, target).first().asDict()
        rows += [(name, i, s) for i, s in enumerate(scores)]
        models[name] = (fitted, m, seconds)
    spark = df.sparkSession
    fold_scores = spark.createDataFrame(rows, "model string, fold int, score double")
    holdout = spark.createDataFrame(
        [(n, m["accuracy"], m["roc_auc"], m["precision"], m["recall"], m["f1"], t)
         for n, (_, m, t) in models.items()],
        "model string, accuracy double, roc_auc double, precision double, recall double, "
        "f1 double, seconds double",
    )
    return fold_scores, holdout, {n: f for n, (f, _, _) in models.items()}


__all__ = [
    "evaluate", "stack", "out_of_fold", "Hybrid", "Stacked", "train_v1", "train_v2", "train_eval",
    "compare_models", "plan_v1", "plan_v2", "Plan", "Outcome", "choose_final", "logreg",
    "PipelineModel",
]
