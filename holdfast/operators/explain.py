"""Explanations: attributions as long tables ``(row_id, feature, value, shap)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.joins import lookup
from holdfast.operators.profile import q

DEFAULT_IMPORTANCE = 0.01     # fixed value: weight of a feature without importance


def long_features(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """One row per record and feature. Text features have value 0."""
    def number(c):
        if isinstance(df.schema[c].dataType, T.NumericType):
            return q(c).cast("double")
        return F.lit(0.0)

    entries = [F.struct(F.lit(c).alias("feature"), number(c).alias("value")) for c in cols]
    return df.select(q(id_col).alias("row_id"), F.inline(F.array(*entries)))


def background_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)}


def shap_linear(df: DataFrame, coef: dict[str, float], means: dict[str, float],
                id_col: str) -> DataFrame:
    """Attribution of a linear model: coefficient times distance from the background mean."""
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            q(c).cast("double").alias("value"),
            (F.lit(w) * (q(c).cast("double") - F.lit(means[c]))).alias("shap"),
        )
        for c, w in coef.items()
    ]
    return df.select(q(id_col).alias("row_id"), F.inline(F.array(*entries)))


def linear_base(coef: dict[str, float], intercept: float, means: dict[str, float]) -> float:
    return intercept + sum(w * means[c] for c, w in coef.items())


def explain_global(contrib: DataFrame, digits: int = 6) -> DataFrame:
    """Mean size, mean and population deviation of the attributions per feature."""
    return contrib.groupBy("feature").agg(
        F.round(F.avg(F.abs("shap")), digits).alias("mean_abs_shap"),
        F.round(F.avg("shap"), digits).alias("mean_shap"),
        F.round(F.stddev_pop("shap"), digits).alias("std_shap"),
    ).orderBy(F.desc("mean_abs_shap"), "feature")


def approx_contributions(df: DataFrame, importance: DataFrame, id_col: str,
                         cols: Sequence[str]) -> DataFrame:
    """Value times importance; unknown features get the default importance."""
    long = long_features(df, id_col, cols)
    weighted = lookup(long, importance, "feature", "importance", DEFAULT_IMPORTANCE)
    return weighted.withColumn("contribution", F.col("value") * F.col("importance"))


def _strongest(entries: Column, side: Column, k: int) -> Column:
    """The ``k`` largest entries of one side, by size and then by name."""
    ordered = F.sort_array(F.transform(
        F.filter(entries, lambda x: side(x["impact"])),
        lambda x: F.struct((-F.abs(x["impact"])).alias("o"), x["feature"].alias("feature"),
                           x["value"].alias("value"), x["impact"].alias("impact")),
    ))
    return F.transform(F.slice(ordered, 1, k), lambda x, i: F.struct(
        (i + 1).alias("rank"), x["feature"].alias("feature"), x["value"].alias("value"),
        x["impact"].alias("impact"),
    ))


def with_factors(df: DataFrame, entries: Column, k: int = 5,
                 zero_is_negative: bool = False) -> DataFrame:
    """Add the strongest factors of either sign, as two ordered arrays.

    ``entries`` is an array of ``(feature, value, impact)``. A record has one entry per feature,
    so everything happens inside the row and nothing is shuffled.
    """
    def up(x):
        return x > 0

    def down(x):
        return x <= 0 if zero_is_negative else x < 0

    return df.withColumns({
        "churn_factors": _strongest(entries, up, k),
        "retention_factors": _strongest(entries, down, k),
    })


def linear_entries(coef: dict[str, float], means: dict[str, float]) -> Column:
    """Linear attributions of a record as an array of ``(feature, value, impact)``."""
    return F.array(*[
        F.struct(
            F.lit(c).alias("feature"), q(c).cast("double").alias("value"),
            (F.lit(w) * (q(c).cast("double") - F.lit(means[c]))).alias("impact"),
        )
        for c, w in coef.items()
    ])


def approx_entries(df: DataFrame, importance: DataFrame, cols: Sequence[str]) -> Column:
    """Value times importance of every column, as an array of ``(feature, value, impact)``.

    Importance is asked for these columns only, one number each.
    """
    known = importance.filter(F.col("feature").isin(list(cols))).collect()
    weight = {r["feature"]: r["importance"] for r in known}

    def number(c):
        if isinstance(df.schema[c].dataType, T.NumericType):
            return F.coalesce(q(c).cast("double"), F.lit(0.0))
        return F.lit(0.0)

    return F.array(*[
        F.struct(
            F.lit(c).alias("feature"), number(c).alias("value"),
            (number(c) * F.lit(weight.get(c, DEFAULT_IMPORTANCE))).alias("impact"),
        )
        for c in cols
    ])


def long_entries(contrib: DataFrame, value: str = "shap") -> DataFrame:
    """A long attribution table as one array per record, for ``with_factors``."""
    return contrib.groupBy("row_id").agg(F.collect_list(
        F.struct("feature", "value", F.col(value).alias("impact"))
    ).alias("entries"))


def explanation_text(df: DataFrame, prediction: str = "prediction", p: str = "p") -> DataFrame:
    """Text with up to three factors of either sign; the order follows the predicted class."""
    def lines(col, fmt):
        shown = F.transform(F.slice(F.col(col), 1, 3), lambda x: F.format_string(
            fmt, x["feature"], x["value"], x["impact"]
        ))
        return F.array_join(shown, "")

    up = lines("churn_factors", "  • %s: %.2f (impact: +%.3f)\n")
    down = lines("retention_factors", "  • %s: %.2f (impact: %.3f)\n")
    # fixed values: wording of the two texts
    churns = q(prediction) == 1
    sure = F.when(churns, q(p)).otherwise(F.lit(1.0) - q(p)) * 100.0
    text = F.when(churns, F.concat(
        F.format_string("This customer is likely to churn (confidence: %.1f%%).\n\n", sure),
        F.lit("Key factors increasing churn risk:\n"), up,
        F.lit("\nFactors helping retention:\n"), down,
    )).otherwise(F.concat(
        F.format_string("This customer is likely to stay (confidence: %.1f%%).\n\n", sure),
        F.lit("Key factors supporting retention:\n"), down,
        F.lit("\nPotential churn risk factors to monitor:\n"), up,
    ))
    return df.withColumn("explanation_text", text)


def explain_rows(scored: DataFrame, entries: Column, base: float, id_col: str,
                 prediction: str = "prediction", p: str = "p") -> DataFrame:
    """Prediction, both probabilities, base value, factors and text per record."""
    rows = with_factors(scored.withColumns({
        "row_id": q(id_col), "prediction": q(prediction).cast("int"), "p": q(p),
    }), entries)
    return explanation_text(rows).select(
        "row_id", "prediction",
        F.struct((F.lit(1.0) - F.col("p")).alias("no_churn"), F.col("p").alias("churn"))
        .alias("probability"),
        F.lit(float(base)).alias("base_value"),
        "churn_factors", "retention_factors", "explanation_text",
    )


def approx_text(df: DataFrame, prediction: str = "prediction", p: str = "p") -> DataFrame:
    """Short sentence with the three leading factors of the predicted side."""
    def names(col):
        return F.array_join(F.transform(F.slice(F.col(col), 1, 3), lambda x: x["feature"]), ", ")

    text = F.when(q(prediction) == 1, F.concat(
        F.format_string("This customer has a %.1f%% probability of churning (ML model prediction)."
                        " Main risk factors: ", q(p) * 100.0), names("churn_factors"),
    )).otherwise(F.concat(
        F.format_string("This customer is likely to stay (retention: %.1f%%). Positive factors: ",
                        (F.lit(1.0) - q(p)) * 100.0), names("retention_factors"),
    ))
    return df.withColumn("explanation_text", text)
