"""Evaluation metrics of a binary classifier.

Scores are counted per distinct probability first; curves, areas and losses all come from those
counts, so a table with a hot score shrinks before it is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import long_rows, q
from holdfast.operators.rank import threshold_counts

CLIP = 2.220446049250313e-16     # smallest relative step of a double

BUNDLE = [
    "accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision",
    "matthews_corrcoef", "cohen_kappa", "log_loss", "brier_score",
]
HYBRID_BUNDLE = BUNDLE[:7]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, g = q(label), q(prediction)
    return df.agg(
        F.count_if((y == 0) & (g == 0)).alias("tn"),
        F.count_if((y == 0) & (g == 1)).alias("fp"),
        F.count_if((y == 1) & (g == 0)).alias("fn"),
        F.count_if((y == 1) & (g == 1)).alias("tp"),
    )


def _from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Metrics that need the four counts only."""
    tn, fp, fn, tp = [c.cast("double") for c in (tn, fp, fn, tp)]
    n = tn + fp + fn + tp
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    acc = (tp + tn) / n
    return {
        "accuracy": acc,
        "precision": prec,
        "recall": rec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "matthews_corrcoef": _ratio(
            tp * tn - fp * fn,
            F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn),
        ),
        "cohen_kappa": _ratio(acc - chance, 1 - chance),
    }


def basic_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  digits: int = 6) -> DataFrame:
    """Accuracy, precision, recall and F1; empty denominators give 0."""
    m = _from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    names = ["accuracy", "precision", "recall", "f1"]
    return confusion(df, label, prediction).select(*[F.round(m[n], digits).alias(n) for n in names])


def matthews(df, label="label", prediction="prediction", digits: int = 6) -> DataFrame:
    m = _from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])["matthews_corrcoef"]
    return confusion(df, label, prediction).select(F.round(m, digits).alias("matthews_corrcoef"))


def kappa(df, label="label", prediction="prediction", digits: int = 6) -> DataFrame:
    m = _from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])["cohen_kappa"]
    return confusion(df, label, prediction).select(F.round(m, digits).alias("cohen_kappa"))


def _area(pos: Column, neg: Column, tp: Column, fp: Column) -> Column:
    """Trapezoid under the curve: ties count one half."""
    area = F.sum(neg.cast("double") * (tp - pos) + 0.5 * neg.cast("double") * pos)
    return F.try_divide(area, F.sum(pos).cast("double") * F.sum(neg))


def _step_precision(pos: Column, tp: Column, fp: Column) -> Column:
    return F.try_divide(F.sum(pos * (tp / (tp + fp))), F.sum(pos))


def roc_auc(df, label="label", p="p", digits: int = 6, splits=None) -> DataFrame:
    pts = threshold_counts(df, label, p, splits=splits)
    area = _area(F.col("pos"), F.col("neg"), F.col("tp"), F.col("fp"))
    return pts.agg(F.round(area, digits).alias("roc_auc"))


def average_precision(df, label="label", p="p", digits: int = 6, splits=None) -> DataFrame:
    pts = threshold_counts(df, label, p, splits=splits)
    ap = _step_precision(F.col("pos"), F.col("tp"), F.col("fp"))
    return pts.agg(F.round(ap, digits).alias("avg_precision"))


def _losses(p: Column) -> tuple[Column, Column]:
    """Loss of one positive and of one negative row, probability clipped."""
    clipped = F.greatest(F.lit(CLIP), F.least(F.lit(1.0 - CLIP), p))
    return -F.ln(clipped), -F.ln(F.lit(1.0) - clipped)


def log_loss(df, label="label", p="p", digits: int = 6) -> DataFrame:
    hit, miss = _losses(q(p))
    return df.agg(F.round(F.avg(F.when(q(label) == 1, hit).otherwise(miss)), digits)
                  .alias("log_loss"))


def brier(df, label="label", p="p", digits: int = 6) -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(q(p) - q(label), 2)), digits).alias("brier_score"))


def metric_bundle(
    df: DataFrame, label: str = "label", prediction: str = "prediction", p: str = "p",
    digits: int = 6, names: Sequence[str] = BUNDLE, splits: Sequence[float] | None = None,
) -> DataFrame:
    """All metrics in one row from one count per distinct score."""
    pts = threshold_counts(df, label, p, prediction, splits)
    pos, neg, t = F.col("pos"), F.col("neg"), F.col("threshold")
    hit, miss = _losses(t)
    n = F.sum(pos + neg)
    sums = pts.agg(
        F.sum("tp_at").alias("tp"), F.sum("fp_at").alias("fp"),
        F.sum(pos - F.col("tp_at")).alias("fn"), F.sum(neg - F.col("fp_at")).alias("tn"),
        _area(pos, neg, F.col("tp"), F.col("fp")).alias("roc_auc"),
        _step_precision(pos, F.col("tp"), F.col("fp")).alias("avg_precision"),
        (F.sum(pos * hit + neg * miss) / n).alias("log_loss"),
        (F.sum(pos * F.pow(t - 1, 2) + neg * F.pow(t, 2)) / n).alias("brier_score"),
    )
    m = _from_counts(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    for c in ("roc_auc", "avg_precision", "log_loss", "brier_score"):
        m[c] = F.col(c)
    return sums.select(*[F.round(m[c], digits).alias(c) for c in names])


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows."""
    cells = df.groupBy(q(label).cast("int").alias("y"), q(prediction).cast("int").alias("g")).agg(
        F.count("*").alias("n")
    )
    none = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("g"), F.col("n")).otherwise(none)
    sides = long_rows(
        cells,
        [(F.col("y"), F.col("n"), hit, none), (F.col("g"), none, none, F.col("n"))],
        ["class", "support", "tp", "guessed"],
    )
    per = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"),
        F.sum("guessed").alias("guessed"),
    ).select(
        F.col("class").cast("string").alias("name"),
        _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(F.col("tp") * 2.0, F.col("guessed") + F.col("support")).alias("f1"),
        "support", "tp",
    )
    values = ["precision", "recall", "f1"]
    total = F.sum("support")
    accuracy = per.agg(
        F.lit("accuracy").alias("name"),
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        (F.sum("tp") / total).alias("f1"), total.alias("support"),
    )
    macro = per.agg(
        F.lit("macro avg").alias("name"), *[F.avg(v).alias(v) for v in values],
        total.alias("support"),
    )
    weighted = per.agg(
        F.lit("weighted avg").alias("name"),
        *[(F.sum(F.col(v) * F.col("support")) / total).alias(v) for v in values],
        total.alias("support"),
    )
    rows = per.drop("tp").unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return rows.select("name", *[F.round(v, digits).alias(v) for v in values], "support")
