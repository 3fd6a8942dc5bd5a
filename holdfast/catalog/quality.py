"""Registered queries: validation (C), preprocessing (F), splits (G), joins (H)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.catalog.base import (
    LIMIT, NOW, PROFILE, any_rule, prof, types_sql, union_all,
)
from holdfast.catalog.exploration import FEATURE_SQL
from holdfast.functions import features as fe
from holdfast.operators import joins, prep, rules, split, validate as va
from holdfast.operators.clean import feature_lists
from holdfast.schema import (
    BOUNDS, CATEGORICAL, CATEGORIES, CUSTOMER_SCHEMA, HOURLY_PRICE, NUMERIC, TARGET,
)
from holdfast.sources import tables as tb

COLUMNS = CUSTOMER_SCHEMA.fieldNames()
Q, S = {}, {}

# ---- C: validation ---------------------------------------------------------------------------
FAULTY = f"""{PROFILE.strip()}, base AS (
  SELECT * FROM prof UNION ALL SELECT * FROM prof WHERE "Age" = 30
), faulty AS (
  SELECT "CustomerID",
    CASE WHEN "Age" = 18 THEN 150 WHEN "Age" = 42 THEN 101 ELSE "Age" END AS "Age",
    CASE WHEN "Age" = 40 THEN 'Unknown' ELSE "Gender" END AS "Gender",
    "Tenure", "Usage Frequency", "Support Calls", "Payment Delay",
    CASE WHEN "Age" = 41 THEN 'Enterprise' WHEN "Age" <> 42 THEN "Subscription Type" END
      AS "Subscription Type",
    "Contract Length",
    CASE WHEN NOT "Age" BETWEEN 60 AND 65 THEN "Total Spend" END AS "Total Spend",
    "Last Interaction",
    CASE WHEN "Age" < 70 AND "Age" <> 33 THEN 0 ELSE "Churn" END AS "Churn",
    'none' AS "Region"
  FROM base
)"""


def _dict_sql(pairs, quote: str, sep: str = ": ") -> str:
    """Text of a mapping; entries with a null value are left out."""
    parts = ", ".join(
        f"CASE WHEN {cond} THEN '{quote}{name}{quote}{sep}' || CAST({value} AS VARCHAR) END"
        for name, cond, value in pairs
    )
    return f"concat_ws(', ', {parts})"


def _checks_sql(src: str, extra: list[str]) -> str:
    cols = COLUMNS + extra
    nulls = ", ".join(f'count(*) - count("{c}") AS z{i}' for i, c in enumerate(cols))
    bounds = ", ".join(
        f"""CAST(sum(CASE WHEN "{c}" < {lo} OR "{c}" > {hi} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}"""
        for i, (c, (lo, hi)) in enumerate(BOUNDS.items())
    )
    cats = ", ".join(
        f"""list_sort(list(DISTINCT CASE WHEN "{c}" NOT IN ({", ".join(f"'{v}'" for v in vs)})
        THEN "{c}" END) FILTER ("{c}" NOT IN ({", ".join(f"'{v}'" for v in vs)}))) AS k{i}"""
        for i, (c, vs) in enumerate(CATEGORIES.items())
    )
    agg = f"""agg AS (SELECT count(*) AS n, count(*) - count(DISTINCT "CustomerID") AS dup,
      avg("Churn") AS rate, {nulls}, {bounds}, {cats} FROM {src})"""
    pct = "pct AS (SELECT " + ", ".join(
        f"round(z{i} * CAST(100.0 AS DOUBLE) / n, 2) AS p{i}" for i in range(len(cols))
    ) + " FROM agg)"
    fences = "fences AS (SELECT " + ", ".join(
        f"""quantile_cont(CAST("{c}" AS DOUBLE), 0.25) AS a{i},
        quantile_cont(CAST("{c}" AS DOUBLE), 0.75) AS c{i}""" for i, c in enumerate(NUMERIC)
    ) + f" FROM {src})"
    outl = "outl AS (SELECT " + ", ".join(
        f"""CAST(sum(CASE WHEN "{c}" < a{i} - 1.5 * (c{i} - a{i})
        OR "{c}" > c{i} + 1.5 * (c{i} - a{i}) THEN 1 ELSE 0 END) AS BIGINT) AS o{i}"""
        for i, c in enumerate(NUMERIC)
    ) + f" FROM {src}, fences)"
    missing = [(c, f"p{i} > 0", f"p{i}") for i, c in enumerate(cols)]
    critical = [(c, f"p{i} > 5", f"p{i}") for i, c in enumerate(cols)]
    any_missing = " OR ".join(f"p{i} > 0" for i in range(len(cols)))
    any_critical = " OR ".join(f"p{i} > 5" for i in range(len(cols)))
    outs = [(c, f"o{i} > 0", f"o{i}") for i, c in enumerate(NUMERIC)]
    n_out = " + ".join(f"CASE WHEN o{i} > 0 THEN 1 ELSE 0 END" for i in range(len(NUMERIC)))
    total_out = " + ".join(f"o{i}" for i in range(len(NUMERIC)))
    rows = []
    if extra:
        rows.append(f"""SELECT 'schema_completeness' AS check_name, 'warning' AS status,
          'Extra columns found: [''{"', '".join(extra)}'']' AS message,
          '{{"extra_columns": ["{'", "'.join(extra)}"]}}' AS details""".replace(
            "', '".join(extra), "'', ''".join(extra)))
    else:
        rows.append("""SELECT 'schema_completeness' AS check_name, 'passed' AS status,
          'All expected columns present' AS message, NULL AS details""")
    rows.append(f"""SELECT 'missing_values',
      CASE WHEN {any_critical} THEN 'failed' WHEN {any_missing} THEN 'warning' ELSE 'passed' END,
      CASE WHEN {any_critical} THEN 'Critical missing values (>5%): {{' ||
             {_dict_sql(critical, "''")} || '}}'
           WHEN {any_missing} THEN 'Minor missing values detected: {{' ||
             {_dict_sql(missing, "''")} || '}}'
           ELSE 'No missing values detected' END,
      CASE WHEN {any_missing} THEN '{{"missing_percentages": {{' || {_dict_sql(missing, '"')}
           || '}}}}' END FROM pct""")
    rows.append("""SELECT 'duplicate_check', CASE WHEN dup > 0 THEN 'warning' ELSE 'passed' END,
      CASE WHEN dup > 0 THEN 'Found ' || dup || ' duplicate CustomerIDs'
           ELSE 'No duplicate CustomerIDs found' END,
      CASE WHEN dup > 0 THEN '{"duplicate_count": ' || dup || '}' END FROM agg""")
    for i, c in enumerate(CATEGORIES):
        rows.append(f"""SELECT 'categorical_values_{c}',
          CASE WHEN len(k{i}) > 0 THEN 'failed' ELSE 'passed' END,
          CASE WHEN len(k{i}) > 0 THEN 'Invalid values in {c}: [''' ||
            array_to_string(k{i}, ''', ''') || ''']' ELSE 'All values in {c} are valid' END,
          CASE WHEN len(k{i}) > 0 THEN '{{"invalid_values": ["' ||
            array_to_string(k{i}, '", "') || '"]}}' END FROM agg""")
    for i, (c, (lo, hi)) in enumerate(BOUNDS.items()):
        p = f"(b{i} * CAST(100.0 AS DOUBLE) / n)"
        rows.append(f"""SELECT 'bounds_check_{c}',
          CASE WHEN b{i} = 0 THEN 'passed' WHEN {p} > 1 THEN 'failed' ELSE 'warning' END,
          CASE WHEN b{i} = 0 THEN '{c} values within expected bounds'
               WHEN {p} > 1 THEN '{c}: ' || b{i} || ' values (' || printf('%.2f', {p})
                 || '%) out of bounds [{lo}, {hi}]'
               ELSE '{c}: Minor bound violations (' || b{i} || ' values)' END,
          CASE WHEN b{i} = 0 THEN NULL
               WHEN {p} > 1 THEN '{{"out_of_bounds_count": ' || b{i} || ', "percentage": '
                 || round({p}, 2) || '}}'
               ELSE '{{"out_of_bounds_count": ' || b{i} || '}}' END FROM agg""")
    rows.append(f"""SELECT 'outlier_detection',
      CASE WHEN {total_out} > 0 THEN 'warning' ELSE 'passed' END,
      CASE WHEN {total_out} > 0 THEN 'Outliers detected in ' || ({n_out}) || ' columns (total: '
             || ({total_out}) || ')' ELSE 'No significant outliers detected' END,
      CASE WHEN {total_out} > 0 THEN '{{"outliers_per_column": {{' || {_dict_sql(outs, '"')}
             || '}}}}' END FROM outl""")
    rows.append("""SELECT 'target_balance',
      CASE WHEN rate < 0.05 OR rate > 0.95 THEN 'failed'
           WHEN rate < 0.1 OR rate > 0.9 THEN 'warning' ELSE 'passed' END,
      CASE WHEN rate < 0.05 OR rate > 0.95 THEN 'Severe' WHEN rate < 0.1 OR rate > 0.9
           THEN 'Moderate' ELSE 'Acceptable' END
        || CASE WHEN rate < 0.1 OR rate > 0.9 THEN ' class imbalance: ' ELSE ' class balance: ' END
        || printf('%.2f', rate * 100) || '% churn rate',
      '{"churn_rate": ' || round(rate, 4) || '}' FROM agg""")
    numbered = [f"SELECT {i} AS ordinal, * FROM ({r})" for i, r in enumerate(rows)]
    return ", ".join([agg, pct, fences, outl, "results AS (" + union_all(numbered) + ")"])


CHECKS = f"WITH {PROFILE.strip()}, " + _checks_sql("prof", [])
FAULTY_CHECKS = f"WITH {FAULTY}, " + _checks_sql("faulty", ["Region"])


def _faulty(s, d):
    return tb.faulty_profile(tb.profile_table(s, d))


Q["c_run_checks"] = lambda s, d: va.run_checks(tb.profile_table(s, d))
S["c_run_checks"] = CHECKS + " SELECT * FROM results"
Q["c_run_checks_faulty"] = lambda s, d: va.run_checks(_faulty(s, d))
S["c_run_checks_faulty"] = FAULTY_CHECKS + " SELECT * FROM results"

for _n, _prefix, _fn in [
    ("c1_check_schema", "schema_completeness", va.check_schema),
    ("c2_check_missing", "missing_values", va.check_missing),
    ("c3_check_duplicates", "duplicate_check", va.check_duplicates),
    ("c4_check_categories", "categorical_values", va.check_categories),
    ("c5_check_bounds", "bounds_check", va.check_bounds),
    ("c6_check_outliers", "outlier_detection", va.check_outliers),
    ("c7_check_balance", "target_balance", va.check_balance),
]:
    Q[_n] = lambda s, d, fn=_fn: fn(_faulty(s, d))
    S[_n] = FAULTY_CHECKS + f""" SELECT * EXCLUDE (ordinal),
      CAST(row_number() OVER (ORDER BY ordinal) - 1 AS INTEGER) AS ordinal
      FROM results WHERE starts_with(check_name, '{_prefix}')"""

Q["c4_invalid_values"] = lambda s, d: va.invalid_values(_faulty(s, d))
S["c4_invalid_values"] = f"WITH {FAULTY} " + union_all(
    f"""SELECT '{c}' AS "column", "{c}" AS value, count(*) AS "count" FROM faulty
    WHERE "{c}" NOT IN ({", ".join(f"'{v}'" for v in vs)}) GROUP BY 2"""
    for c, vs in CATEGORIES.items()
)


def _verdicts(s, d):
    results = va.run_checks(tb.profile_table(s, d))
    return va.verdict(results).withColumn("strict", F.lit(False)).unionByName(
        va.verdict(results, strict=True).withColumn("strict", F.lit(True))
    )


Q["c8_verdict"] = _verdicts
S["c8_verdict"] = CHECKS + """ SELECT bool_and(status <> 'failed') AS passed, false AS strict
  FROM results UNION ALL
  SELECT bool_and(status <> 'failed' AND status <> 'warning'), true FROM results"""

Q["c9_status_counts"] = lambda s, d: va.status_counts(va.run_checks(_faulty(s, d)))
S["c9_status_counts"] = FAULTY_CHECKS + " SELECT count(*) AS total, " + ", ".join(
    f"CAST(sum(CASE WHEN status = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}"
    for x in ("passed", "warning", "failed")
) + " FROM results"

_RULE, _THIN = "=" * 60, "-" * 60
Q["c10_report_lines"] = lambda s, d: va.report_lines(va.run_checks(_faulty(s, d)))
REPORT_PARTS = f"""
  SELECT ordinal + 1 AS part, list_filter([
    '[' || CASE status WHEN 'passed' THEN '✓' WHEN 'warning' THEN '⚠' ELSE '✗' END || '] '
      || check_name, '    Status: ' || upper(status), '    Message: ' || message,
    '    Details: ' || details, ''], lambda x: x IS NOT NULL) AS lines FROM results
  UNION ALL SELECT 0, ['{_RULE}', 'DATA VALIDATION REPORT', '{_RULE}', '']
  UNION ALL SELECT 1000000, ['{_THIN}', 'SUMMARY', '{_THIN}', 'Total Checks: ' || count(*),
    'Passed: ' || count(*) FILTER (status = 'passed'),
    'Warnings: ' || count(*) FILTER (status = 'warning'),
    'Failed: ' || count(*) FILTER (status = 'failed'), '{_RULE}'] FROM results
"""
S["c10_report_lines"] = FAULTY_CHECKS + f""", parts AS ({REPORT_PARTS})
  SELECT part, CAST(unnest(range(len(lines))) AS INTEGER) AS line, unnest(lines) AS text FROM parts
"""

_ERRORS = "concat_ws('; ', " + ", ".join(
    [
        f"""CASE WHEN "{c}" IS NULL THEN '{c}: missing' END,
        CASE WHEN "{c}" < {lo} OR "{c}" > {hi} THEN '{c}: out of [{lo}, {hi}]' END"""
        for c, (lo, hi) in BOUNDS.items()
    ] + [
        f"""CASE WHEN "{c}" IS NULL THEN '{c}: missing' END,
        CASE WHEN "{c}" NOT IN ({", ".join(f"'{v}'" for v in vs)}) THEN '{c}: not allowed' END"""
        for c, vs in CATEGORIES.items()
    ]
) + ")"
Q["c13_split_valid_good"] = lambda s, d: va.split_valid(_faulty(s, d))[0]
S["c13_split_valid_good"] = f"WITH {FAULTY} SELECT * FROM faulty WHERE {_ERRORS} = ''"
Q["c13_split_valid_rejects"] = lambda s, d: va.split_valid(_faulty(s, d))[1].select(
    "CustomerID", F.array_join("errors", "; ").alias("errors")
)
S["c13_split_valid_rejects"] = (
    f'WITH {FAULTY} SELECT "CustomerID", {_ERRORS} AS errors FROM faulty WHERE {_ERRORS} <> \'\''
)

# ---- F: preprocessing ------------------------------------------------------------------------
def _imputed(fit, cols):
    def run(s, d):
        df = _faulty(s, d)
        return fit(df, cols).transform(df).select("CustomerID", *[F.col(f"`{c}`") for c in cols])
    return run


Q["f1_median_imputer"] = _imputed(prep.median_imputer, NUMERIC)
S["f1_median_imputer"] = f"WITH {FAULTY}, med AS (SELECT " + ", ".join(
    f'quantile_cont(CAST("{c}" AS DOUBLE), 0.5) AS m{i}' for i, c in enumerate(NUMERIC)
) + ' FROM faulty) SELECT "CustomerID", ' + ", ".join(
    f'coalesce(CAST("{c}" AS DOUBLE), m{i}) AS "{c}"' for i, c in enumerate(NUMERIC)
) + " FROM faulty, med"

Q["f2_mode_imputer"] = _imputed(prep.mode_imputer, CATEGORICAL)
S["f2_mode_imputer"] = f'WITH {FAULTY} SELECT "CustomerID", ' + ", ".join(
    f"""coalesce("{c}", (SELECT "{c}" FROM faulty WHERE "{c}" IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 1)) AS "{c}" """ for c in CATEGORICAL
) + " FROM faulty"


def _scaled(s, d):
    df = tb.profile_table(s, d)
    out = prep.standard_scaler(df, NUMERIC).transform(df)
    return out.select("CustomerID", *[F.round(f"`{c}`", 6).alias(c) for c in NUMERIC])


Q["f3_standard_scaler"] = _scaled
S["f3_standard_scaler"] = prof('SELECT "CustomerID", ' + ", ".join(
    f'round(("{c}" - m{i}) / d{i}, 6) AS "{c}"' for i, c in enumerate(NUMERIC)
) + " FROM prof, st", "st AS (SELECT " + ", ".join(
    f'avg("{c}") AS m{i}, stddev_pop("{c}") AS d{i}' for i, c in enumerate(NUMERIC)
) + " FROM prof)")

_VALUES = {c: sorted(v) for c, v in CATEGORIES.items()}


def _hot_sql(skip: int, src: str) -> str:
    keep = [c for c in COLUMNS if c not in CATEGORICAL]
    return ("SELECT " + ", ".join(f'"{c}"' for c in keep) + ", " + ", ".join(
        f"""CASE WHEN "{c}" = '{v}' THEN 1 ELSE 0 END AS "{c}_{v}" """
        for c in CATEGORICAL for v in _VALUES[c][skip:]
    ) + f" FROM {src}")


def _hot(drop, unknown):
    def run(s, d):
        df = tb.profile_table(s, d)
        return prep.one_hot(df, CATEGORICAL, drop, unknown).transform(df)
    return run


Q["f4_one_hot"] = _hot(None, "ignore")
S["f4_one_hot"] = prof(_hot_sql(0, "prof"))
Q["f5_one_hot_drop_first"] = _hot("first", "error")
S["f5_one_hot_drop_first"] = prof(_hot_sql(1, "prof"))


def _hot_unknown(s, d):
    """categories learned on clean rows, applied to rows with unknown ones."""
    known = prep.one_hot(tb.customer_profile(s, d), CATEGORICAL, "first", "ignore")
    return known.transform(_faulty(s, d)).drop("Region")


Q["f6_one_hot_unknown_zero"] = _hot_unknown
S["f6_one_hot_unknown_zero"] = f"WITH {FAULTY} " + _hot_sql(1, "faulty")
Q["f7_dummies"] = lambda s, d: prep.dummies(tb.profile_table(s, d), exclude=["CustomerID"])
S["f7_dummies"] = prof(_hot_sql(1, "prof"))


def _factorized(s, d):
    key = F.substring("CustomerID", 10, 9).cast("long")
    coded, _ = prep.factorize(_faulty(s, d), "Subscription Type", key)
    return coded.select("CustomerID", "Age", "Subscription Type", "code")


_FIRST = f"""WITH {FAULTY}, first AS (SELECT "Subscription Type" AS v,
  min(CAST(substr("CustomerID", 10, 9) AS BIGINT)) AS k FROM faulty
  WHERE "Subscription Type" IS NOT NULL GROUP BY 1
), codes AS (SELECT v AS value, row_number() OVER (ORDER BY k, v) - 1 AS code FROM first)"""
Q["f8_factorize"] = _factorized
S["f8_factorize"] = _FIRST + """ SELECT "CustomerID", "Age", "Subscription Type",
  coalesce(code, -1) AS code FROM faulty LEFT JOIN codes ON "Subscription Type" = value"""
Q["f8_factorize_codes"] = lambda s, d: prep.factorize_codes(
    _faulty(s, d), "Subscription Type", F.substring("CustomerID", 10, 9).cast("long")
)
S["f8_factorize_codes"] = _FIRST + " SELECT * FROM codes"

V1_NUMERIC = [*NUMERIC, *fe.V1_FEATURES]


def _preprocessed(s, d):
    """the fitted pipeline, its vector spread over named columns."""
    df = fe.engineer_v1(tb.profile_table(s, d))
    numeric, categorical = feature_lists(df)
    pre = prep.build_preprocessor(df, numeric, categorical)
    arr = pre.transform(df).select("CustomerID", vector_to_array("features").alias("x"))
    return arr.select(
        "CustomerID", *[F.round(F.col("x")[i], 6).alias(n) for i, n in
                        enumerate(pre.feature_names)]
    )


Q["f9_f10_preprocessor"] = _preprocessed
S["f9_f10_preprocessor"] = prof(
    'SELECT "CustomerID", ' + ", ".join(
        [f'round((x{i} - m{i}) / d{i}, 6) AS "{c}"' for i, c in enumerate(V1_NUMERIC)]
        + [f'CAST(CASE WHEN "{c}" = \'{v}\' THEN 1 ELSE 0 END AS DOUBLE) AS "{c}_{v}"'
           for c in CATEGORICAL for v in _VALUES[c]]
    ) + " FROM filled, st",
    "eng AS (SELECT *, " + ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in fe.V1_FEATURES)
    + " FROM prof)",
    "med AS (SELECT " + ", ".join(
        f'quantile_cont(CAST("{c}" AS DOUBLE), 0.5) AS q{i}' for i, c in enumerate(V1_NUMERIC)
    ) + " FROM eng)",
    "filled AS (SELECT *, " + ", ".join(
        f'coalesce(CAST("{c}" AS DOUBLE), q{i}) AS x{i}' for i, c in enumerate(V1_NUMERIC)
    ) + " FROM eng, med)",
    "st AS (SELECT " + ", ".join(
        f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1 ELSE stddev_pop(x{i}) END "
        f"AS d{i}" for i in range(len(V1_NUMERIC))
    ) + " FROM filled)",
)


def _numeric_only(s, d):
    """columns a numeric-only consumer would reject, before and after encoding."""
    df = tb.customer_profile(s, d)
    from holdfast.operators.clean import non_numeric
    after = non_numeric(prep.dummies(df.drop("CustomerID")))
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(",".join(non_numeric(df))).alias("before"),
        F.lit(",".join(after)).alias("after"),
    )


Q["f11_non_numeric"] = _numeric_only
S["f11_non_numeric"] = prof(
    "SELECT count(*) AS n_rows, 'CustomerID,Gender,Subscription Type,Contract Length' AS before, "
    "'' AS after FROM prof"
)

# ---- G: splits -------------------------------------------------------------------------------
_KEY = "md5('42:' || \"CustomerID\")"
Q["g1_stratified_split"] = lambda s, d: split.stratified_split(
    tb.profile_table(s, d), TARGET
).select("CustomerID", "Churn", "is_train")
S["g1_stratified_split"] = prof(f"""SELECT "CustomerID", "Churn",
  row_number() OVER (PARTITION BY "Churn" ORDER BY {_KEY}, "CustomerID")
  <= floor(0.8 * count(*) OVER (PARTITION BY "Churn") + 0.5) AS is_train FROM prof""")

Q["g2_random_split"] = lambda s, d: split.random_split(
    tb.profile_table(s, d)
).select("CustomerID", "is_train")
S["g2_random_split"] = prof(f"""SELECT "CustomerID", row_number() OVER (ORDER BY {_KEY},
  "CustomerID") <= floor(0.8 * count(*) OVER () + 0.5) AS is_train FROM prof""")

Q["g2_hash_split"] = lambda s, d: split.hash_split(
    tb.customer_profile(s, d)
).select("CustomerID", "is_train")
S["g2_hash_split"] = prof(f"""SELECT "CustomerID",
  CAST('0x' || substr({_KEY}, 1, 8) AS BIGINT) < {int(0.8 * 2**32)} AS is_train FROM prof""")


def _sample_size(df):
    return df.count() // 3


def _strat_sample(s, d):
    df = tb.profile_table(s, d)
    return split.stratified_sample(df, TARGET, _sample_size(df)).select("CustomerID", "Churn")


Q["g3_stratified_sample"] = _strat_sample
S["g3_stratified_sample"] = prof(
    f"""SELECT "CustomerID", "Churn" FROM (
      SELECT "CustomerID", "Churn", row_number() OVER (PARTITION BY "Churn"
        ORDER BY {_KEY}, "CustomerID") AS r FROM prof) JOIN quota USING ("Churn")
    WHERE r <= quota""",
    """sizes AS (SELECT "Churn", count(*) AS c, (SELECT count(*) FROM prof) AS t,
      (SELECT count(*) // 3 FROM prof) AS n FROM prof GROUP BY 1)""",
    """quota AS (SELECT "Churn", n * c // t + CASE WHEN row_number() OVER (
      ORDER BY (n * c) % t DESC, "Churn") <= n - sum(n * c // t) OVER () THEN 1 ELSE 0 END AS quota
      FROM sizes)""",
)

Q["g4_sample_n"] = lambda s, d: split.sample_n(tb.customer_profile(s, d), 100)
S["g4_sample_n"] = prof(f'SELECT * FROM prof ORDER BY {_KEY}, "CustomerID" LIMIT 100')

Q["g5_shuffle_split"] = lambda s, d: split.shuffle_split(
    tb.profile_table(s, d), 0.8
).select("CustomerID", "is_train")
S["g5_shuffle_split"] = prof(f"""SELECT "CustomerID", row_number() OVER (ORDER BY {_KEY},
  "CustomerID") <= floor(0.8 * count(*) OVER ()) AS is_train FROM prof""")

for _k in (3, 5):
    Q[f"g6_add_folds_{_k}"] = lambda s, d, k=_k: split.add_folds(
        tb.profile_table(s, d), TARGET, k
    ).select("CustomerID", "Churn", "fold")
    S[f"g6_add_folds_{_k}"] = prof(f"""SELECT "CustomerID", "Churn",
      CAST((row_number() OVER (PARTITION BY "Churn" ORDER BY {_KEY}, "CustomerID") - 1) % {_k}
      AS INTEGER) AS fold FROM prof""")

Q["g7_shuffle_labels"] = lambda s, d: split.shuffle_labels(
    tb.profile_table(s, d), TARGET
).select("CustomerID", "Churn", "shuffled")
S["g7_shuffle_labels"] = prof(f"""SELECT "CustomerID", "Churn", shuffled FROM (
    SELECT "CustomerID", "Churn", row_number() OVER (ORDER BY {_KEY}, "CustomerID") AS pos
    FROM prof) JOIN (SELECT "Churn" AS shuffled, row_number() OVER (
      ORDER BY md5('43:' || "CustomerID"), "CustomerID") AS pos FROM prof) USING (pos)""")

# ---- H: joins --------------------------------------------------------------------------------


def _halves(s, d):
    """Training and test rows with all columns; those of one age are planted in both."""
    marked = split.stratified_split(tb.profile_table(s, d), TARGET)
    both = F.col("Age") == 30
    return (marked.filter(F.col("is_train") | both).drop("is_train"),
            marked.filter(~F.col("is_train") | both).drop("is_train"))


Q["h1_overlap"] = lambda s, d: joins.overlap(*_halves(s, d))
S["h1_overlap"] = prof(
    'SELECT count(*) AS overlapping FROM marked a JOIN marked b ON (a.is_train OR a."Age" = 30) '
    'AND (NOT b.is_train OR b."Age" = 30) '
    + "".join(f'AND a."{f.name}" IS NOT DISTINCT FROM b."{f.name}" ' for f in CUSTOMER_SCHEMA.fields),
    f"""marked AS (SELECT *, row_number() OVER (PARTITION BY "Churn" ORDER BY {_KEY}, "CustomerID")
      <= floor(0.8 * count(*) OVER (PARTITION BY "Churn") + 0.5) AS is_train FROM prof)""",
)


def _side_by_side(s, d):
    df = tb.customer_profile(s, d)
    return joins.concat_columns(
        df.select("CustomerID", "Age", "Tenure"), df.select("CustomerID", "Churn"), "CustomerID"
    )


Q["h2_concat_columns"] = _side_by_side
S["h2_concat_columns"] = prof('SELECT "CustomerID", "Age", "Tenure", "Churn" FROM prof')

PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({v} AS DOUBLE))" for k, v in HOURLY_PRICE.items()
) + ") t(instance_type, hourly))"


def _job_price(s, d):
    jobs = tb.ledger_jobs(s, d).select("job", "instance_type")
    return joins.lookup(jobs, tb.price_table(s), "instance_type", "hourly", 0.115)


Q["h3_h4_lookup"] = _job_price
S["h3_h4_lookup"] = f"""WITH {PRICES}, jobs AS (SELECT 'job-' || o_orderkey AS job,
  {types_sql("o_orderkey")} AS instance_type FROM orders)
  SELECT job, jobs.instance_type, coalesce(hourly, 0.115) AS hourly FROM jobs LEFT JOIN prices
  ON jobs.instance_type = prices.instance_type"""

ENDPOINTS = f"""endpoints AS (SELECT s_name AS name,
    CASE WHEN s_suppkey % 4 = 3 THEN 'Deleting' ELSE 'InService' END AS status,
    CASE WHEN s_suppkey % 10 <> 9 THEN TIMESTAMP '{NOW}'
      - to_milliseconds((s_suppkey % 100000) * 2221007 + 677003) END AS created_at,
    'config-' || s_suppkey AS config, s_suppkey AS k FROM supplier
), variants AS (
  SELECT k, 0 AS position, {types_sql("k")} AS instance_type,
    CAST(1 + k % 3 AS INTEGER) AS instance_count FROM endpoints WHERE k % 17 <> 5
  UNION ALL SELECT k, 1, {types_sql("k + 2")}, 1 FROM endpoints WHERE k % 17 <> 5 AND k % 2 = 0
  UNION ALL SELECT k, NULL, NULL, NULL FROM endpoints WHERE k % 17 = 5
)"""


def _variants(s, d):
    return joins.endpoint_variants(tb.ledger_endpoints(s, d), tb.ledger_configs(s, d)).select(
        "name", "status", "config", "position", F.col("variant.instance_type"),
        F.col("variant.instance_count"),
    )


Q["h5_endpoint_variants"] = _variants
S["h5_endpoint_variants"] = f"""WITH {ENDPOINTS} SELECT name, status, config, position,
  instance_type, instance_count FROM endpoints JOIN variants USING (k)"""


def _branches(s, d):
    df = tb.profile_table(s, d)
    hit = rules.fit_rules(df).mask()
    by_rule = df.filter(hit).select("CustomerID", F.lit(1.0).alias("p"))
    by_model = df.filter(~hit).select("CustomerID", tb.closed_form_score().alias("p"))
    return joins.merge_branches(by_rule, by_model)


Q["h6_merge_branches"] = _branches
S["h6_merge_branches"] = prof(
    f"""SELECT "CustomerID", CASE WHEN {any_rule("(SELECT q20 FROM spend)")} THEN 1.0 ELSE
    round(1.0 / (1.0 + exp(-(CAST(0.1 AS DOUBLE) * ("Support Calls" - 2)
      + CAST(0.05 AS DOUBLE) * ("Payment Delay" - 10)))), 6) END AS p FROM prof""", LIMIT,
)

QUERIES, ORACLES = Q, S
