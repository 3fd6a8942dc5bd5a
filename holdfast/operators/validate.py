"""Validation checks of a table, and row-level quarantine of bad records.

``run_checks`` takes one aggregate for all counting checks, the exact quartiles, and one count outside
the outlier fences. Only those sums reach the driver, where they become result rows; wrong values of
categories are listed by a join of the result.
"""

from __future__ import annotations

import json
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.profile import is_missing, long_rows, nan_to_null, q
from holdfast.operators.quantiles import quantiles
from holdfast.schema import CUSTOMER_SPEC, ValidationSpec

PASSED, WARNING, FAILED = "passed", "warning", "failed"
RESULT_SCHEMA = "ordinal int, check_name string, status string, message string, details string"
CHECKS = ("schema", "missing", "duplicates", "categories", "bounds", "outliers", "balance")

# Limits of the checks.
MISSING_LIMIT_PCT = 5
BOUNDS_LIMIT_PCT = 1
SEVERE_LOW, SEVERE_HIGH = 0.05, 0.95
MODERATE_LOW, MODERATE_HIGH = 0.10, 0.90


def _details(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


# Names and messages of the checks follow.
def _schema_check(df: DataFrame, spec: ValidationSpec) -> list[tuple]:
    missing = sorted(set(spec.columns) - set(df.columns))
    extra = sorted(set(df.columns) - set(spec.columns))
    name = "schema_completeness"
    if missing:
        return [(name, FAILED, f"Missing columns: {missing}", {"missing_columns": missing})]
    if extra:
        return [(name, WARNING, f"Extra columns found: {extra}", {"extra_columns": extra})]
    return [(name, PASSED, "All expected columns present", None)]


def _missing_check(counts: dict[str, int], rows: int) -> list[tuple]:
    name = "missing_values"
    pct = {c: round(n / rows * 100, 2) for c, n in counts.items() if n > 0}
    critical = {c: v for c, v in pct.items() if v > MISSING_LIMIT_PCT}
    details = {"missing_percentages": pct}
    if critical:
        text = f"Critical missing values (>{MISSING_LIMIT_PCT}%): {critical}"
        return [(name, FAILED, text, details)]
    if pct:
        return [(name, WARNING, f"Minor missing values detected: {pct}", details)]
    return [(name, PASSED, "No missing values detected", None)]


def _duplicate_check(n: int, id_col: str) -> list[tuple]:
    name = "duplicate_check"
    if n > 0:
        return [(name, WARNING, f"Found {n} duplicate {id_col}s", {"duplicate_count": n})]
    return [(name, PASSED, f"No duplicate {id_col}s found", None)]


def _category_check(col: str, bad_rows: int) -> list[tuple]:
    """A failed check holds the column only; ``_frame`` adds the values."""
    name = f"categorical_values_{col}"
    if bad_rows == 0:
        return [(name, PASSED, f"All values in {col} are valid", None)]
    return [(name, FAILED, f"Invalid values in {col}: ", None)]


def _bounds_check(col: str, low, high, n: int, rows: int) -> list[tuple]:
    name = f"bounds_check_{col}"
    if n == 0:
        return [(name, PASSED, f"{col} values within expected bounds", None)]
    pct = n / rows * 100
    if pct > BOUNDS_LIMIT_PCT:
        text = f"{col}: {n} values ({pct:.2f}%) out of bounds [{low}, {high}]"
        return [(name, FAILED, text, {"out_of_bounds_count": n, "percentage": round(pct, 2)})]
    text = f"{col}: Minor bound violations ({n} values)"
    return [(name, WARNING, text, {"out_of_bounds_count": n})]


def _outlier_check(outliers: dict[str, int]) -> list[tuple]:
    name = "outlier_detection"
    found = {c: n for c, n in outliers.items() if n > 0}
    if found:
        text = f"Outliers detected in {len(found)} columns (total: {sum(found.values())})"
        return [(name, WARNING, text, {"outliers_per_column": found})]
    return [(name, PASSED, "No significant outliers detected", None)]


def _balance_check(rate: float | None) -> list[tuple]:
    name = "target_balance"
    if rate is None:
        return [(name, FAILED, "No labelled rows", None)]
    details = {"churn_rate": round(rate, 4)}
    if rate < SEVERE_LOW or rate > SEVERE_HIGH:
        return [(name, FAILED, f"Severe class imbalance: {rate:.2%} churn rate", details)]
    if rate < MODERATE_LOW or rate > MODERATE_HIGH:
        return [(name, WARNING, f"Moderate class imbalance: {rate:.2%} churn rate", details)]
    return [(name, PASSED, f"Acceptable class balance: {rate:.2%} churn rate", details)]


def _outside(col: str, low, high) -> Column:
    return (q(col) < F.lit(low)) | (q(col) > F.lit(high))


def outlier_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Values outside 1.5 interquartile ranges, per column."""
    found = quantiles(df, {c: q(c) for c in cols}, [0.25, 0.75])
    fences = {
        c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in found.items() if a is not None
    }
    if not fences:
        return {}
    row = df.agg(*[
        F.count_if(_outside(c, *f)).alias(f"o{i}") for i, (c, f) in enumerate(fences.items())
    ]).first()
    return {c: row[f"o{i}"] for i, c in enumerate(fences)}


def invalid_values(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    """Every value outside its allowed set, with its number of rows."""
    cols = [c for c in spec.categories if c in df.columns]
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.when(~q(c).isin(spec.categories[c]), q(c)).alias("value"),
        )
        for c in cols
    ])
    return (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("count"))
    )


def check_rows(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC,
               only: Collection[str] = CHECKS) -> list[tuple]:
    """The wanted checks as ``(name, status, message, details)``; others cost nothing."""
    df = nan_to_null(df)
    cols = df.columns
    results = _schema_check(df, spec) if "schema" in only else []
    if not cols:
        return results + _missing_check({}, 0) + _outlier_check({})
    nulls = cols if "missing" in only else []
    cats = [c for c in spec.categories if c in cols and "categories" in only]
    bounds = [c for c in spec.bounds if c in cols and "bounds" in only]
    has_id = spec.id_col in cols and "duplicates" in only
    has_target = spec.target in cols and "balance" in only
    aggs = [F.count_if(is_missing(df, c)).alias(f"null{i}") for i, c in enumerate(nulls)]
    aggs += [F.count_if(_outside(c, *spec.bounds[c])).alias(f"bound{i}")
             for i, c in enumerate(bounds)]
    aggs += [F.count_if(~q(c).isin(spec.categories[c])).alias(f"cat{i}")
             for i, c in enumerate(cats)]
    if has_id:
        unique = F.countDistinct(q(spec.id_col)) + F.max(
            F.when(q(spec.id_col).isNull(), 1).otherwise(0)
        )
        aggs.append((F.count("*") - unique).alias("repeats"))
    if has_target:
        aggs.append(F.avg(q(spec.target)).alias("rate"))
    if aggs:
        row = df.agg(F.count("*").alias("rows"), *aggs).first()
        rows = row["rows"]
    if nulls:
        results += _missing_check({c: row[f"null{i}"] for i, c in enumerate(nulls)}, rows)
    if has_id:
        results += _duplicate_check(row["repeats"] or 0, spec.id_col)
    for i, c in enumerate(cats):
        results += _category_check(c, row[f"cat{i}"])
    for i, c in enumerate(bounds):
        results += _bounds_check(c, *spec.bounds[c], row[f"bound{i}"], rows)
    if "outliers" in only:
        numeric = [
            f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in (spec.id_col, spec.target)
        ]
        results += _outlier_check(outlier_counts(df, numeric) if numeric else {})
    if has_target:
        results += _balance_check(row["rate"])
    return results


def _shown(values: Column) -> Column:
    """A list of texts as Python shows it."""
    plain = F.lit("'")

    def one(v: Column) -> Column:
        v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
        return F.when(v.contains("'") & ~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"'))) \
            .otherwise(F.concat(plain, F.replace(v, plain, F.lit("\\'")), plain))

    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]"))


def _as_json(values: Column) -> Column:
    """A list of texts as JSON with a blank after each comma."""
    def one(v: Column) -> Column:
        text = F.to_json(F.array(v))
        return F.substr(text, F.lit(2), F.length(text) - 2)

    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ", "), F.lit("]"))


def _frame(df: DataFrame, spec: ValidationSpec, results: list[tuple]) -> DataFrame:
    """Result rows; wrong values of categories are listed by Spark, all of them."""
    out = df.sparkSession.createDataFrame(
        [(i, n, s, m, _details(d)) for i, (n, s, m, d) in enumerate(results)], RESULT_SCHEMA
    )
    prefix = "categorical_values_"
    if not any(n.startswith(prefix) and s == FAILED for n, s, _, _ in results):
        return out
    listed = invalid_values(nan_to_null(df), spec).groupBy("column").agg(
        F.sort_array(F.collect_list("value")).alias("values")
    ).select(F.concat(F.lit(prefix), F.col("column")).alias("_name"), "values")
    shown = F.col("values").isNotNull()
    return out.join(listed, out.check_name == F.col("_name"), "left").select(
        "ordinal", "check_name", "status",
        F.when(shown, F.concat("message", _shown(F.col("values")))).otherwise(F.col("message"))
        .alias("message"),
        F.when(shown, F.concat(F.lit('{"invalid_values": '), _as_json(F.col("values")), F.lit("}")))
        .otherwise(F.col("details")).alias("details"),
    )


def run_checks(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    """One row per check."""
    return _frame(df, spec, check_rows(df, spec))


def _only(df: DataFrame, spec: ValidationSpec, check: str) -> DataFrame:
    return _frame(df, spec, check_rows(df, spec, {check}))


def check_schema(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _frame(df, spec, _schema_check(df, spec))


def check_missing(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "missing")


def check_duplicates(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "duplicates")


def check_categories(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "categories")


def check_bounds(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "bounds")


def check_outliers(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "outliers")


def check_balance(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC) -> DataFrame:
    return _only(df, spec, "balance")


def verdict(results: DataFrame, strict: bool = False) -> DataFrame:
    """Whether the table passes; strict mode also fails on warnings."""
    ok = F.col("status") != FAILED
    if strict:
        ok = ok & (F.col("status") != WARNING)
    return results.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in (PASSED, WARNING, FAILED)],
    )


def report_lines(results: DataFrame) -> DataFrame:
    """The report as numbered lines; a result has four to five, the summary closes it."""
    icon = F.when(F.col("status") == PASSED, "✓").when(F.col("status") == WARNING, "⚠")
    body = results.select(
        (F.col("ordinal") + 1).alias("part"),
        F.array_compact(F.array(
            F.concat(F.lit("["), icon.otherwise("✗"), F.lit("] "), F.col("check_name")),
            F.concat(F.lit("    Status: "), F.upper("status")),
            F.concat(F.lit("    Message: "), F.col("message")),
            F.concat(F.lit("    Details: "), F.col("details")),
            F.lit(""),
        )).alias("lines"),
    )
    rule, thin = "=" * 60, "-" * 60
    head = F.array(*[F.lit(x) for x in (rule, "DATA VALIDATION REPORT", rule, "")])
    tail = F.array(
        F.lit(thin), F.lit("SUMMARY"), F.lit(thin),
        F.concat(F.lit("Total Checks: "), F.col("total").cast("string")),
        F.concat(F.lit("Passed: "), F.col(PASSED).cast("string")),
        F.concat(F.lit("Warnings: "), F.col(WARNING).cast("string")),
        F.concat(F.lit("Failed: "), F.col(FAILED).cast("string")),
        F.lit(rule),
    )
    ends = long_rows(
        status_counts(results), [(F.lit(0), head), (F.lit(1_000_000), tail)], ["part", "lines"]
    )
    return body.unionByName(ends).select("part", F.posexplode("lines").alias("line", "text"))


def report_text(results: DataFrame) -> str:
    rows = report_lines(results).orderBy("part", "line").collect()
    return "\n".join(r["text"] for r in rows)


def row_errors(spec: ValidationSpec = CUSTOMER_SPEC, required: bool = True) -> Column:
    """Reasons why a record is unusable; empty when it is fine."""
    reasons = []
    for c, (low, high) in spec.bounds.items():
        if required:
            reasons.append(F.when(q(c).isNull(), F.lit(f"{c}: missing")))
        reasons.append(F.when(_outside(c, low, high), F.lit(f"{c}: out of [{low}, {high}]")))
    for c, allowed in spec.categories.items():
        if required:
            reasons.append(F.when(q(c).isNull(), F.lit(f"{c}: missing")))
        reasons.append(F.when(~q(c).isin(allowed), F.lit(f"{c}: not allowed")))
    return F.array_compact(F.array(*reasons))


def split_valid(df: DataFrame, spec: ValidationSpec = CUSTOMER_SPEC):
    """Usable records, and the others with their reasons."""
    marked = nan_to_null(df).withColumn("errors", row_errors(spec))
    good = marked.filter(F.size("errors") == 0).drop("errors")
    return good, marked.filter(F.size("errors") > 0)
