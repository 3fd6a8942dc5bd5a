"""Classifiers: estimators by name, class weights, fitted pipelines, importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasLabelCol, HasMaxIter, HasStandardization, HasTol, HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.clean import feature_lists
from holdfast.operators.prep import Preprocessor, build_preprocessor
from holdfast.operators.profile import q
from holdfast.plans.boosting import Booster
from holdfast.plans.kernel import KernelClassifier
from holdfast.schema import TARGET

SEED = 42

# Column roles shared by all estimators.
ROLES = {"featuresCol": "features", "labelCol": "label"}


class RidgeLogistic(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasTol,
                    HasStandardization, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression with the inverse regularisation ``C`` of a summed loss.

    Spark penalises the mean loss, so the ridge weight is ``1 / (C * n)``, with ``n`` the rows, or
    the sum of their weights. It is set when the model is fitted.
    """

    C = Param(Params._dummy(), "C", "inverse weight of the ridge penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, maxIter=1000,
                 tol=1e-6, standardization=False, C=1.0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=1000, tol=1e-6,
                         standardization=False, C=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        weighted = weight_of(self)
        n = dataset.agg(F.sum(weighted[0]) if weighted else F.count("*")).first()[0]
        given = {p.name: v for p, v in self.extractParamMap().items() if p.name != "C"}
        return LogisticRegression(regParam=1.0 / (self.getOrDefault("C") * (n or 1)), **given).fit(
            dataset)


def logreg(C: float = 1.0, **params) -> RidgeLogistic:
    """Logistic regression; ``C`` is the inverse weight of the ridge penalty."""
    return RidgeLogistic(**ROLES, C=C, **params)


def rf(**params) -> RandomForestClassifier:
    """Random forest. Spark grows trees to a depth of 30 at most.

    Rows keep their node of each tree, so a level does not walk every tree from its root again; the trees are the
    same.
    """
    return RandomForestClassifier(**ROLES, **{"numTrees": 100, "maxDepth": 10, "seed": SEED,
                                              "cacheNodeIds": True, **params})


def gbt(**params) -> GBTClassifier:
    """Gradient-boosted trees on first-order gradients."""
    return GBTClassifier(**ROLES, **{"maxIter": 100, "maxDepth": 5, "stepSize": 0.1,
                                     "seed": SEED, **params})


def booster(**params) -> Booster:
    """Second-order boosting by level, with leaf penalties."""
    return Booster(**ROLES, **{"seed": SEED, **params})


def leaf_booster(**params) -> Booster:
    """Second-order boosting leaf by leaf; its depth is as good as unlimited."""
    return Booster(**ROLES, **{"numLeaves": 31, "maxDepth": 64, "minInstancesPerNode": 20,
                               "minChildWeight": 1e-3, "regLambda": 0.0, "seed": SEED, **params})


def kernel_svm(**params) -> KernelClassifier:
    """Margin classifier with a Gaussian kernel and calibrated probabilities."""
    return KernelClassifier(**ROLES, **{"seed": SEED, **params})


def linear_svm(**params) -> Pipeline:
    """Linear margin classifier; a logistic fit of the margin gives probabilities."""
    svc = LinearSVC(**ROLES, **{"maxIter": 100, "predictionCol": "_margin_label",
                                "rawPredictionCol": "_margin", **params})
    margin = VectorAssembler(inputCols=["_margin"], outputCol="_margin_vector")
    calibrate = LogisticRegression(featuresCol="_margin_vector", labelCol="label", maxIter=100)
    return Pipeline(stages=[svc, margin, calibrate])


def tree(**params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(**ROLES, **{"maxDepth": 5, "seed": SEED, **params})


FACTORY: dict[str, Callable[..., Estimator]] = {
    "logistic_regression": logreg,
    "random_forest": rf,
    "gradient_boosting": gbt,
    "xgboost": booster,
    "lightgbm": leaf_booster,
    "svm": kernel_svm,
    "linear_svm": linear_svm,
    "decision_tree": tree,
}


def make_model(name: str, params: dict | None = None) -> Estimator:
    """Estimator by name. The names of boosting libraries mean growth by level and by leaf."""
    if name not in FACTORY:
        raise ValueError(f"unknown algorithm {name!r}; choose from {sorted(FACTORY)}")
    return FACTORY[name](**(params or {}))


def class_weights(df: DataFrame, target: str = TARGET, mode: str = "balanced",
                  positive: float = 1.0) -> DataFrame:
    """Weight per class: ``balanced`` is n / (classes * n_class); ``positive`` scales class 1."""
    counts = df.groupBy(q(target).alias("value")).agg(F.count("*").alias("n"))
    if mode == "balanced":
        both = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t"))
        total = both.scalar()
        weight = total["n"] / (total["k"] * F.col("n"))
    elif mode == "unbalanced":
        total = counts.agg(F.struct(
            F.sum(F.when(F.col("value") == 0, F.col("n"))).alias("neg"),
            F.sum(F.when(F.col("value") == 1, F.col("n"))).alias("pos"),
        ).alias("t")).scalar()
        weight = F.when(F.col("value") == 1, total["neg"] / total["pos"]).otherwise(1.0)
    else:
        weight = F.when(F.col("value") == 1, F.lit(float(positive))).otherwise(1.0)
    return counts.withColumn("weight", F.round(weight, 9))


def with_weights(df: DataFrame, target: str = TARGET, mode: str = "balanced",
                 positive: float = 1.0, out: str = "weight") -> DataFrame:
    """Add the class weight of every row; there is one number per class."""
    rows = class_weights(df, target, mode, positive).collect()
    pairs = [x for r in rows for x in (F.lit(r["value"]), F.lit(r["weight"]))]
    return df.withColumn(out, F.create_map(*pairs)[q(target)])


#: Weight columns that estimators can name as ``weightCol``: mode and weight of class 1.
WEIGHTS = {
    "w_none": ("positive", 1.0), "w_positive_3": ("positive", 3.0),
    "w_positive_6": ("positive", 6.0), "w_unbalanced": ("unbalanced", 1.0),
    "w_balanced": ("balanced", 1.0),
}


def weight_columns(data: DataFrame, names) -> DataFrame:
    """Add the named weight columns to prepared rows."""
    for name in sorted(set(names) & set(WEIGHTS)):
        mode, positive = WEIGHTS[name]
        data = with_weights(data, "label", mode, positive, name)
    return data


def weight_of(estimator: Estimator) -> list[str]:
    """The weight column an estimator asks for."""
    if estimator.hasParam("weightCol") and estimator.isDefined("weightCol"):
        return [estimator.getOrDefault("weightCol")]
    return []


def spark_params(estimator: Estimator, params: dict) -> dict:
    """Named parameters as Spark's own parameter map."""
    return {estimator.getParam(k): v for k, v in params.items()}


@dataclass
class Fitted:
    """Preprocessing and classifier as one persistable pipeline."""

    name: str
    pipeline: PipelineModel
    feature_names: list[str]

    @property
    def classifier(self) -> Model:
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (int), ``p`` (of class 1) and ``confidence``; vectors are dropped."""
        extra = ["features", "rawPrediction", "probability", "_margin", "_margin_label",
                 "_margin_vector", "_kernel", *[f"_f{i}" for i in range(len(self.feature_names))]]
        both = vector_to_array("probability")
        return (
            self.pipeline.transform(df)
            .withColumns({"p": both[1], "confidence": F.array_max(both),
                          "prediction": F.col("prediction").cast("int")})
            .drop(*extra)
        )


def prepared(pre: Preprocessor, df: DataFrame, target: str = TARGET,
             keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector and label only; what training reads again and again."""
    extra = [F.col(f"`{c}`") for c in keep]
    return pre.transform(df.withColumn("label", q(target).cast("double"))).select(
        "features", "label", *extra
    )


def fit_pipeline(df: DataFrame, estimator: Estimator, name: str, target: str = TARGET,
                 pre: Preprocessor | None = None) -> Fitted:
    """Fit preprocessing (unless given) and the classifier."""
    if pre is None:
        numeric, categorical = feature_lists(df, target)
        pre = build_preprocessor(df, numeric, categorical)
    model = estimator.fit(weight_columns(prepared(pre, df, target), weight_of(estimator)))
    tail = model.stages if isinstance(model, PipelineModel) else [model]
    return Fitted(name, PipelineModel([*pre.stages(), *tail]), pre.feature_names)


def importance_rows(fitted: Fitted) -> list[tuple[str, float]]:
    """Feature importance, highest first; empty when the model has none or lengths differ."""
    values = getattr(fitted.classifier, "featureImportances", None)
    if values is None or len(values) != len(fitted.feature_names):
        return []
    pairs = zip(fitted.feature_names, (float(v) for v in values.toArray()))
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


def feature_importance(spark, fitted: Fitted) -> DataFrame:
    return spark.createDataFrame(importance_rows(fitted), "feature string, importance double")


def save_model(fitted: Fitted, path: str, rules_limit: float | None = None) -> None:
    """Write the pipeline, and beside it the feature names and the fitted rule limit."""
    fitted.pipeline.write().overwrite().save(f"{path}/pipeline")
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    meta = spark.createDataFrame(
        [(fitted.name, fitted.feature_names, rules_limit)],
        "name string, feature_names array<string>, rules_limit double",
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark, path: str) -> tuple[Fitted, float | None]:
    meta = spark.read.parquet(f"{path}/meta").first()
    pipeline = PipelineModel.load(f"{path}/pipeline")
    return Fitted(meta["name"], pipeline, list(meta["feature_names"])), meta["rules_limit"]
