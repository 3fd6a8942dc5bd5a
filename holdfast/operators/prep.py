"""Preprocessing: fitted numbers, applied as column expressions.

``build_preprocessor`` ends as a ``SQLTransformer`` and a ``VectorAssembler``, so a fitted pipeline
is saved and loaded by Spark ML itself and runs without Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordering import running_sums, score_splits, with_score_bucket
from holdfast.operators.profile import columns_by_type, is_missing, q
from holdfast.operators.quantiles import quantiles


@dataclass
class Imputer:
    """Fill missing values with fitted ones."""

    fill: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.when(is_missing(df, c), F.lit(v)).otherwise(q(c)) for c, v in self.fill.items()
        })


def median_imputer(df: DataFrame, cols: Sequence[str]) -> Imputer:
    found = quantiles(df, {c: q(c) for c in cols}, [0.5])
    return Imputer({c: found[c][0] for c in cols})


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per column and value, from one scan."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols
    ])
    return (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("count"))
    )


def mode_imputer(df: DataFrame, cols: Sequence[str]) -> Imputer:
    """Most frequent value; the smallest wins ties."""
    best = category_counts(df, cols).groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")
    )
    return Imputer({r["column"]: r["value"] for r in best.collect()})


def _category_rows(df: DataFrame, cols: Sequence[str]) -> list:
    """Every category; each becomes a column, so there are as few as columns can be."""
    return category_counts(df, cols).collect()


@dataclass
class Scaler:
    """Subtract the mean, divide by the population deviation; constant columns keep scale 1."""

    stats: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()
        })


def standard_scaler(df: DataFrame, cols: Sequence[str], values: dict[str, Column] | None = None):
    values = values or {c: q(c) for c in cols}
    row = df.agg(*[
        e for i, c in enumerate(cols)
        for e in (F.avg(values[c]).alias(f"m{i}"), F.stddev_pop(values[c]).alias(f"s{i}"))
    ]).first()
    return Scaler({
        c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0)
        for i, c in enumerate(cols)
    })


@dataclass
class OneHot:
    """Indicator columns per category.

    ``drop="first"`` leaves out the alphabetically first category. Unknown values give zeros, or
    fail the job with ``unknown="error"``.
    """

    categories: dict
    drop: str | None = None
    unknown: str = "ignore"

    def indicators(self) -> dict[str, tuple[str, str]]:
        """Output name -> (column, category)."""
        start = 1 if self.drop == "first" else 0
        return {f"{c}_{v}": (c, v) for c, vs in self.categories.items() for v in vs[start:]}

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for name, (c, v) in self.indicators().items():
            hit = F.coalesce(q(c) == F.lit(v), F.lit(False)).cast("int")
            if self.unknown == "error":
                known = q(c).isin(self.categories[c])
                message = F.concat(F.lit(f"unknown category in {c}: "), q(c))
                hit = F.when(known, hit).otherwise(F.raise_error(message).cast("int"))
            new[name] = hit
        return df.withColumns(new).drop(*self.categories)


def one_hot(df: DataFrame, cols: Sequence[str], drop: str | None = None,
            unknown: str = "ignore") -> OneHot:
    return _one_hot_of(_category_rows(df, cols), cols, drop, unknown)


def _one_hot_of(rows: list, cols: Sequence[str], drop: str | None, unknown: str) -> OneHot:
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        found[r["column"]].append(r["value"])
    return OneHot({c: sorted(v) for c, v in found.items()}, drop, unknown)


def dummies(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Drop-first indicators for every string column."""
    _, text = columns_by_type(df)
    cols = [c for c in text if c not in exclude]
    return one_hot(df, cols, drop="first").transform(df)


def factorize_codes(df: DataFrame, col: str, order_by: Column) -> DataFrame:
    """Code of each value by first appearance; ``order_by`` is numeric."""
    first = (
        df.filter(~is_missing(df, col)).groupBy(q(col).alias("value"))
        .agg(F.min(order_by.cast("double")).alias("first"))
    )
    bucketed = with_score_bucket(first, "first", score_splits(first, "first"))
    ranked = running_sums(
        bucketed, {"pos": F.lit(1)}, "_bucket", [F.col("first"), F.col("value")]
    )
    return ranked.select("value", (F.col("pos") - 1).cast("long").alias("code"))


def factorize(df: DataFrame, col: str, order_by: Column, out: str = "code"):
    """Integer codes of a column (missing is -1) and the code table."""
    codes = factorize_codes(df, col, order_by)
    side = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    coded = (
        df.join(side, q(col) == F.col("_value"), "left")
        .withColumn(out, F.coalesce("_code", F.lit(-1)).cast("long")).drop("_value", "_code")
    )
    return coded, codes


def _sql_number(x: float) -> str:
    return f"{float(x)!r}D"


def _sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Preprocessor:
    """Fitted numeric and categorical branches, as a persistable pipeline."""

    numeric: list[str]
    categorical: list[str]
    median: Imputer
    mode: Imputer
    scaler: Scaler
    hot: OneHot

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *self.hot.indicators()]

    def statement(self) -> str:
        exprs = []
        for c in self.numeric:
            m, s = self.scaler.stats[c]
            value = f"CAST(`{c}` AS DOUBLE)"
            fill = self.median.fill.get(c)
            if fill is not None:
                value = f"coalesce(nanvl({value}, NULL), {_sql_number(fill)})"
            exprs.append(f"({value} - {_sql_number(m)}) / {_sql_number(s)}")
        for c, v in self.hot.indicators().values():
            value = f"`{c}`"
            fill = self.mode.fill.get(c)
            if fill is not None:
                value = f"coalesce({value}, {_sql_text(fill)})"
            exprs.append(f"CAST(coalesce({value} = {_sql_text(v)}, false) AS DOUBLE)")
        listed = ", ".join(f"{e} AS `_f{i}`" for i, e in enumerate(exprs))
        return f"SELECT *, {listed} FROM __THIS__"

    def stages(self) -> list:
        n = len(self.feature_names)
        return [
            SQLTransformer(statement=self.statement()),
            VectorAssembler(inputCols=[f"_f{i}" for i in range(n)], outputCol="features"),
        ]

    def model(self) -> PipelineModel:
        return PipelineModel(self.stages())

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(self.feature_names)
        return self.model().transform(df).drop(*[f"_f{i}" for i in range(n)])


def build_preprocessor(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], impute: bool = True,
    drop: str | None = None, unknown: str = "ignore",
) -> Preprocessor:
    """Fit imputation, scaling and encoding; scaling sees the imputed values."""
    numeric, categorical = list(numeric), list(categorical)
    median = median_imputer(df, numeric) if impute else Imputer()
    rows = _category_rows(df, categorical) if categorical else []
    mode = Imputer()
    if impute:                        # most frequent first, the smallest value wins ties
        for r in sorted(rows, key=lambda r: (-r["count"], r["value"])):
            mode.fill.setdefault(r["column"], r["value"])
    filled = {
        c: F.coalesce(F.nanvl(q(c).cast("double"), F.lit(None)), F.lit(median.fill[c]))
        if median.fill.get(c) is not None else q(c).cast("double")
        for c in numeric
    }
    scaler = standard_scaler(df, numeric, filled) if numeric else Scaler()
    hot = _one_hot_of(rows, categorical, drop, unknown)
    return Preprocessor(numeric, categorical, median, mode, scaler, hot)
