"""Deterministic churn rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import long_rows, nan_to_null, q
from holdfast.operators.quantiles import quantile
from holdfast.schema import FIXED_SPEND_LIMIT, SPEND_QUANTILE, TARGET


@dataclass(frozen=True)
class Rule:
    """A named predicate, with the column and wording used in explanations."""

    name: str
    predicate: Column
    column: str | None = None
    text: str | None = None

    @property
    def fires(self) -> Column:
        """True or false, never unknown."""
        return F.coalesce(self.predicate, F.lit(False))


class RuleSet:
    """An ordered list of rules; user rules are ``Rule`` or ``(name, Column)``."""

    def __init__(self, rules):
        self.rules = [r if isinstance(r, Rule) else Rule(*r) for r in rules]

    def mask(self) -> Column:
        return reduce(lambda a, b: a | b, [r.fires for r in self.rules], F.lit(False))

    def fired(self) -> Column:
        """Array of the rules that fire on a row."""
        entries = [
            F.when(
                r.fires,
                F.struct(
                    F.lit(r.column or r.name).alias("feature"),
                    (q(r.column).cast("string") if r.column else F.lit(None).cast("string"))
                    .alias("value"),
                    F.lit(1.0).alias("contribution"),
                    F.lit(r.text or r.name).alias("rule"),
                ),
            )
            for r in self.rules
        ]
        return F.filter(F.array(*entries), lambda x: x.isNotNull())


def churn_rules(spend: float = FIXED_SPEND_LIMIT) -> RuleSet:
    """The four churn rules with a given spend limit."""
    # fixed values: limits and wording of the rules
    sure = "→ 100% churn in training data"
    return RuleSet([
        Rule("high_support_calls", q("Support Calls") >= 6, "Support Calls",
             f"Support Calls >= 6 {sure}"),
        Rule("monthly_contract", q("Contract Length") == "Monthly", "Contract Length",
             f"Monthly contract {sure}"),
        Rule("high_payment_delay", q("Payment Delay") > 20, "Payment Delay",
             f"Payment Delay > 20 {sure}"),
        Rule("very_low_spend", q("Total Spend") <= F.lit(float(spend)), "Total Spend",
             f"Total Spend <= {float(spend)} {sure}"),
    ])


def fit_threshold(df: DataFrame, col: str = "Total Spend", p: float = SPEND_QUANTILE) -> float:
    """Spend limit learned from the table."""
    found = quantile(df, col, p)
    if found is None:
        raise ValueError(f"{col} has no values to learn a limit from")
    return found


def fit_rules(df: DataFrame) -> RuleSet:
    return churn_rules(fit_threshold(df))


def rule_mask(df: DataFrame, rules: RuleSet, out: str = "deterministic") -> DataFrame:
    return nan_to_null(df).withColumn(out, rules.mask())


def fired_rules(df: DataFrame, rules: RuleSet, out: str = "fired") -> DataFrame:
    return nan_to_null(df).withColumn(out, rules.fired())


def rule_analysis(df: DataFrame, rules: RuleSet, target: str = TARGET) -> DataFrame:
    """Rows, share and class rate of every rule and of all rules together, in one pass."""
    masks = [(r.name, r.fires) for r in rules.rules] + [("combined", rules.mask())]
    agg = nan_to_null(df).agg(
        F.count("*").alias("n"),
        *[F.count_if(m).alias(f"c{i}") for i, (_, m) in enumerate(masks)],
        *[F.avg(F.when(m, q(target))).alias(f"r{i}") for i, (_, m) in enumerate(masks)],
    )
    rows = [
        (
            F.lit(name), F.col(f"c{i}"),
            F.round(F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")), 1),
            F.round(F.coalesce(f"r{i}", F.lit(0.0)), 4),
        )
        for i, (name, _) in enumerate(masks)
    ]
    return long_rows(agg, rows, ["rule", "count", "pct", "churn_rate"])


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.7, "HIGH").when(p >= 0.4, "MEDIUM").otherwise("LOW")


def source_tag(mask: Column) -> Column:
    return F.when(mask, "rules").otherwise("ml")


def scored_columns(df: DataFrame, rules: RuleSet, p: Column, guess: Column) -> DataFrame:
    """Hybrid result columns from any model probability and label: rules come first."""
    hit = rules.mask()
    prob = F.when(hit, 1.0).otherwise(p)
    return nan_to_null(df).withColumns({
        "churn_prediction": F.when(hit, 1).otherwise(guess).cast("int"),
        "churn_probability": F.round(prob, 4),
        "retention_probability": F.round(F.lit(1.0) - prob, 4),
        "risk_level": risk_level(prob),
        "prediction_source": source_tag(hit),
    })


def batch_summary(pred: DataFrame) -> DataFrame:
    """Totals of a scored batch by outcome, source and risk level."""
    churn = F.count_if(F.col("churn_prediction") == 1)
    by_rule = F.count_if(F.col("prediction_source") == "rules")
    level = {x: F.count_if(F.col("risk_level") == x) for x in ("HIGH", "MEDIUM", "LOW")}
    n = F.count("*")
    return pred.agg(
        n.alias("total_customers"),
        churn.alias("predicted_churners"),
        F.round(churn / F.greatest(n, F.lit(1)), 4).alias("churn_rate"),
        by_rule.alias("rules_engine_matches"),
        (n - by_rule).alias("ml_model_predictions"),
        level["HIGH"].alias("high_risk_count"),
        level["MEDIUM"].alias("medium_risk_count"),
        level["LOW"].alias("low_risk_count"),
    )


def compare_actual(pred: DataFrame, p: str = "p", actual: str = "label") -> DataFrame:
    """Strict 0.5 cut, compared with the known outcome."""
    guess = (q(p) > 0.5).cast("int")

    def word(c):
        return F.when(c == 1, "CHURN").otherwise("STAY")

    return pred.withColumns({
        "predicted": word(guess),
        "actual": word(q(actual)),
        "correct": F.when(guess == q(actual), "✓").otherwise("✗"),
        "text": F.format_string("Probability=%.1f%%", q(p) * 100.0),
    })


def rule_explanation(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Explanation sentence of every row a rule fires on."""
    fired = nan_to_null(df).withColumn("fired", rules.fired()).filter(F.size("fired") > 0)
    texts = F.array_join(F.transform("fired", lambda x: x["rule"]), ", ")
    return fired.withColumn(
        "explanation",
        F.concat(
            F.lit("DETERMINISTIC CHURN (probability=100%). This customer matches "),
            F.size("fired").cast("string"), F.lit(" rule(s): "), texts,
        ),
    )
