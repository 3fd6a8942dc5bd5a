"""Hyperparameter search and the analysis of its trials."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.split import add_folds
from holdfast.plans.models import make_model, prepared, spark_params, weight_columns
from holdfast.schema import ID, TARGET
from holdfast.session import staged

# Search grids, in the names of Spark's parameters. The imbalance handling of each
# library is a weight column here; no limit of depth is a depth of 64. The minimum split size of
# forests has no counterpart in Spark.
GRIDS_V1 = {
    "xgboost": {
        "maxIter": [200, 400, 600, 800], "maxDepth": [4, 6, 8, 10],
        "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.7, 0.8, 0.9],
        "featureFraction": [0.7, 0.8, 0.9], "minChildWeight": [1.0, 3.0, 5.0],
        "gamma": [0.0, 0.1, 0.2], "regAlpha": [0.0, 0.01, 0.1], "regLambda": [1.0, 1.5, 2.0],
    },
    "lightgbm": {
        "maxIter": [200, 400, 600, 800], "maxDepth": [4, 6, 8, 64],
        "stepSize": [0.01, 0.05, 0.1], "numLeaves": [31, 50, 80, 127],
        "subsamplingRate": [0.7, 0.8, 0.9], "featureFraction": [0.7, 0.8, 0.9],
        "minInstancesPerNode": [10, 20, 50], "regAlpha": [0.0, 0.01, 0.1],
        "regLambda": [0.0, 1.0, 2.0],
    },
    "random_forest": {
        "numTrees": [200, 300, 500], "maxDepth": [10, 15, 20],
        "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2"],
    },
}
GRIDS_V2 = {
    "xgboost": {
        "maxIter": [200, 400, 600], "maxDepth": [4, 6, 8],
        "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.7, 0.8, 0.9],
        "featureFraction": [0.7, 0.8, 0.9], "minChildWeight": [1.0, 3.0, 5.0, 10.0],
        "gamma": [0.0, 0.1, 0.3], "regAlpha": [0.0, 0.01, 0.1], "regLambda": [1.0, 1.5, 2.0],
        "weightCol": ["w_none", "w_positive_3", "w_positive_6"],
    },
    "lightgbm": {
        "maxIter": [200, 400, 600], "maxDepth": [4, 6, 8, 64],
        "stepSize": [0.01, 0.05, 0.1], "numLeaves": [31, 50, 80],
        "subsamplingRate": [0.7, 0.8, 0.9], "featureFraction": [0.7, 0.8, 0.9],
        "minInstancesPerNode": [10, 20, 50], "regAlpha": [0.0, 0.01, 0.1],
        "regLambda": [0.0, 1.0, 2.0],
        "weightCol": ["w_unbalanced", "w_none"],
    },
    "random_forest": {
        "numTrees": [200, 300, 500], "maxDepth": [10, 15, 20],
        "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2"],
        "weightCol": ["w_balanced", "w_none"],
    },
}
# Ranges of the managed search, as (kind, low, high) or a list.
RANGES = {
    "random_forest": {
        "numTrees": ("int", 50, 300), "maxDepth": ("int", 3, 20),
        "minInstancesPerNode": ("int", 1, 10),
        "featureSubsetStrategy": ["sqrt", "log2", "auto"],
    },
    "xgboost": {
        "maxIter": ("int", 50, 300), "maxDepth": ("int", 3, 12),
        "stepSize": ("log", 0.01, 0.3), "subsamplingRate": ("float", 0.6, 1.0),
        "featureFraction": ("float", 0.6, 1.0), "gamma": ("float", 0.0, 5.0),
        "regAlpha": ("float", 0.0, 1.0), "regLambda": ("float", 0.0, 1.0),
    },
    "gradient_boosting": {
        "maxIter": ("int", 50, 300), "maxDepth": ("int", 3, 15),
        "stepSize": ("log", 0.01, 0.3), "minInstancesPerNode": ("int", 1, 10),
        "subsamplingRate": ("float", 0.6, 1.0),
    },
}


def f1_positive() -> MulticlassClassificationEvaluator:
    """F1 of class 1."""
    return MulticlassClassificationEvaluator(
        metricName="fMeasureByLabel", metricLabel=1.0, labelCol="label",
        predictionCol="prediction",
    )


def auc() -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        metricName="areaUnderROC", labelCol="label", rawPredictionCol="rawPrediction", numBins=0
    )


def draw(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded draws from grids and ranges."""
    rng = random.Random(seed)

    def one(spec):
        if isinstance(spec, list):
            return rng.choice(spec)
        kind, low, high = spec
        if kind == "int":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{k: one(v) for k, v in space.items()} for _ in range(n)]


def random_search(df: DataFrame, algorithm: str, space: dict, n_iter: int, folds: int, pre,
                  target: str = TARGET, id_col: str = ID, evaluator=None,
                  parallelism: int = 4, seed: int = 42, fixed: dict | None = None):
    """Best parameters, their mean fold score, and all trials.

    Folds come from the hash of the row id. ``parallelism`` trials run as Spark jobs at a time.
    """
    draws = draw(space, n_iter, seed)
    estimator = make_model(algorithm, fixed)
    folded = add_folds(df, target, folds, id_col=id_col)
    weighted = weight_columns(prepared(pre, folded, target, keep=["fold"]),
                              [p["weightCol"] for p in draws if "weightCol" in p])
    data = staged(weighted, "search")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=[spark_params(estimator, p) for p in draws],
        evaluator=evaluator or f1_positive(), numFolds=folds, foldCol="fold", parallelism=parallelism,
    )
    found = search.fit(data)
    trials = [
        (f"trial-{i}", "Completed", _text(p), float(score))
        for i, (p, score) in enumerate(zip(draws, found.avgMetrics))
    ]
    best = max(range(len(trials)), key=lambda i: (trials[i][3], -i))
    table = df.sparkSession.createDataFrame(
        trials, "job string, status string, params string, objective double"
    )
    return draws[best], trials[best][3], table


def _text(params: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in params.items())


def tuning_summary(trials: DataFrame) -> DataFrame:
    """Trials, finished trials, and the best one; the lowest name wins ties."""
    scored = F.col("objective").isNotNull()
    best = F.min_by(
        F.when(scored, F.struct("job", "params", "objective")),
        F.when(scored, F.struct((-F.col("objective")).alias("o"), F.col("job"))),
    )
    return trials.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "Completed").alias("completed_jobs"),
        best.alias("best"),
    ).select(
        "total_jobs", "completed_jobs", F.col("best.job").alias("best_job"),
        F.col("best.params").alias("best_params"),
        F.col("best.objective").alias("best_objective"),
    )


def choose(names: Sequence[str], scores: Sequence[float]) -> str:
    """Name with the highest score; the first one wins ties."""
    return max(zip(names, scores), key=lambda x: x[1])[0]
