"""Reports about trained models: metrics document, model information, model card, run log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import formatted
from holdfast.operators.profile import long_rows
from holdfast.operators.rank import top_importance
from holdfast.operators.rules import RuleSet


def metrics_report(metric_rows: DataFrame, importance: DataFrame, dataset: DataFrame,
                   final_model: str, k: int = 10) -> DataFrame:
    """One nested row: all models, the final one, the dataset block, the leading features.

    Inputs are result tables with a few rows, one per model or feature.
    """
    values = [c for c in metric_rows.columns if c != "model"]
    body = F.struct("model", *[F.round(c, 4).alias(c) for c in values])
    models = metric_rows.agg(F.sort_array(F.collect_list(body)).alias("m")).scalar()
    final = metric_rows.filter(F.col("model") == final_model).select(body).scalar()
    entry = F.struct((-F.col("importance")).alias("o"), "feature", "importance")
    leading = top_importance(importance, k).agg(
        F.sort_array(F.collect_list(entry)).alias("f")
    ).select(F.transform("f", lambda x: F.struct(
        x["feature"].alias("feature"), F.round(x["importance"], 4).alias("importance")
    ))).scalar()
    return dataset.select(
        F.lit(final_model).alias("final_model"),
        F.struct(
            F.col("n").alias("total_rows"), F.round("rate", 4).alias("churn_rate")
        ).alias("dataset"),
        models.alias("all_models"),
        final.alias("final_metrics"),
        leading.alias("feature_importance"),
    )


def report_rows(report: DataFrame, keys=("accuracy", "f1", "brier_score")) -> DataFrame:
    """The report as ``(section, name, key, value)`` rows."""
    names = ["section", "name", "key", "value"]
    per_model = report.select(F.explode("all_models").alias("m"))
    models = long_rows(
        per_model, [(F.lit("model"), F.col("m.model"), F.lit(k), F.col(f"m.{k}")) for k in keys],
        names,
    )
    single = long_rows(report, [
        (F.lit("final"), F.col("final_model"), F.lit("accuracy"), F.col("final_metrics.accuracy")),
        (F.lit("dataset"), F.lit("total_rows"), F.lit("value"),
         F.col("dataset.total_rows").cast("double")),
        (F.lit("dataset"), F.lit("churn_rate"), F.lit("value"), F.col("dataset.churn_rate")),
    ], names)
    features = report.select(F.explode("feature_importance").alias("f")).select(
        F.lit("importance").alias("section"), F.col("f.feature").alias("name"),
        F.lit("importance").alias("key"), F.col("f.importance").alias("value"),
    )
    return models.unionByName(single).unionByName(features)


def model_info(rules: RuleSet, analysis: DataFrame, subset: DataFrame, model_type: str,
               loaded: bool = True, training_metrics: dict | None = None) -> DataFrame:
    """One row about the hybrid approach: rules, their coverage, and the model's training rows.

    ``training_metrics`` holds the metrics of a training job by part (``ml_model_on_ambiguous``,
    ``hybrid_on_full_data``); they are shown as JSON.
    """
    combined = analysis.filter(F.col("rule") == "combined").select("pct").scalar()
    return subset.select(
        F.lit("hybrid").alias("approach"),
        F.lit("Rules Engine for deterministic cases + ML Model for ambiguous cases")
        .alias("description"),
        F.lit("; ".join(r.text or r.name for r in rules.rules)).alias("rules"),
        formatted("%.1f%% of training data", combined).alias("coverage"),
        # fixed values
        F.lit("100% (by definition — deterministic patterns)").alias("precision"),
        F.lit(loaded).alias("loaded"),
        F.lit(model_type).alias("model_type"),
        F.coalesce(
            formatted("%d ambiguous rows (%.1f%% churn rate)", F.col("rows"),
                      F.col("rate") * 100.0),
            F.format_string("%d ambiguous rows", "rows"),
        ).alias("trained_on"),
        F.lit("3.0.0").alias("version"),
        F.lit(json.dumps(training_metrics) if training_metrics else None).cast("string")
        .alias("training_metrics"),
    )


def model_card(metrics: DataFrame, importance: DataFrame, model_type: str, n_features: int,
               now: str) -> DataFrame:
    """Model card as numbered Markdown lines, from one metrics row and a ranking."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))

    ranking = importance.orderBy(F.desc("mean_abs_shap"), "feature").limit(5).agg(
        F.sort_array(F.collect_list(F.struct(
            (-F.col("mean_abs_shap")).alias("o"), "feature", "mean_abs_shap"
        ))).alias("f")
    ).select(F.transform("f", lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". **"), x["feature"], F.lit("**: "),
        F.format_string("%.4f", x["mean_abs_shap"]),
    ))).scalar()
    # fixed values: headings and wording of the card
    text = [F.lit(x) for x in (
        "# Model Card: Customer Churn Prediction", "", "## Model Details",
        f"- **Model Type**: {model_type}", "- **Version**: 2.0",
        f"- **Training Date**: {now[:10]}", "- **Framework**: Spark ML", "",
        "## Intended Use", "- **Primary Use**: Predict customer churn probability",
        "- **Users**: Customer Success teams, Marketing",
        "- **Out-of-scope**: Credit decisions, automated service termination", "",
        "## Training Data", "- **Source**: Customer behavior and demographic data",
        "- **Size**: Specified at training time",
        f"- **Features**: {n_features} features after preprocessing", "",
        "## Performance Metrics",
    )]
    numbers = [
        F.concat(F.lit(f"- **{title}**: "), shown(name)) for title, name in (
            ("Accuracy", "accuracy"), ("ROC-AUC", "roc_auc"), ("Precision", "precision"),
            ("Recall", "recall"), ("F1-Score", "f1"),
        )
    ]
    closing = [F.lit(x) for x in (
        "", "## Ethical Considerations",
        "- Model does not use protected attributes (race, religion, etc.)",
        "- Gender is used as a feature - monitor for disparate impact",
        "- Regular fairness audits recommended", "",
        "## Limitations", "- Performance may degrade with distribution shift",
        "- Requires retraining with new customer segments",
        "- Not suitable for real-time high-frequency predictions", "",
        "## Monitoring Recommendations", "- Track prediction distribution weekly",
        "- Alert on >10% drift in feature distributions",
        "- Quarterly model performance review", "", "---", f"Generated: {now}",
    )]
    lines = F.concat(
        F.array(*text, *numbers, F.lit(""), F.lit("## Feature Importance (Top 5)")),
        F.when(F.size(ranking) > 0, ranking).otherwise(F.array(F.lit("Not available"))),
        F.array(*closing),
    )
    return metrics.select(F.posexplode(lines).alias("line", "text"))


def run_rows(metrics: DataFrame, experiment: str, run_id: str, params: dict) -> DataFrame:
    """One run as long rows ``(experiment, run_id, kind, key, value)``."""
    names = ["experiment", "run_id", "kind", "key", "value"]
    head = [F.lit(experiment), F.lit(run_id)]
    rows = [(*head, F.lit("metric"), F.lit(c), F.col(c).cast("string")) for c in metrics.columns]
    rows += [(*head, F.lit("param"), F.lit(k), F.lit(str(v))) for k, v in params.items()]
    return long_rows(metrics, rows, names)
