import json

import pytest
from pyspark.sql import functions as F

from holdfast.operators import validate as va
from holdfast.schema import CUSTOMER_SCHEMA
from holdfast.sources.readers import validate_path


def statuses(spark, pdf):
    rows = va.run_checks(spark.createDataFrame(pdf)).collect()
    return {r["check_name"]: r["status"] for r in rows}


def passed(spark, pdf, strict=False):
    return va.verdict(va.run_checks(spark.createDataFrame(pdf)), strict).first()["passed"]


def test_valid_rows_pass(spark, valid):
    assert passed(spark, valid)
    assert "failed" not in statuses(spark, valid).values()


def test_missing_columns_fail(spark, valid):
    pdf = valid.drop(columns=["Age", "Gender"])
    found = statuses(spark, pdf)
    assert found["schema_completeness"] == "failed"
    assert "bounds_check_Age" not in found
    assert not passed(spark, pdf)


def test_wrong_categories_fail(spark, valid):
    valid.loc[0, "Gender"] = "Unknown"
    valid.loc[1, "Subscription Type"] = "Enterprise"
    found = statuses(spark, valid)
    assert found["categorical_values_Gender"] == "failed"
    assert found["categorical_values_Subscription Type"] == "failed"
    assert found["categorical_values_Contract Length"] == "passed"


@pytest.mark.parametrize("ages, status", [([150, 10], "failed"), ([150], "warning")])
def test_bounds(spark, valid, ages, status):
    for i, a in enumerate(ages):
        valid.loc[i, "Age"] = a
    assert statuses(spark, valid)["bounds_check_Age"] == status


def test_strict_mode_fails_on_warnings(spark, valid):
    valid.loc[0, "Total Spend"] = 9999.0
    valid.loc[0, "Age"] = 101
    assert passed(spark, valid)
    assert not passed(spark, valid, strict=True)


def test_duplicates_leave_out_the_first(spark, valid):
    valid.loc[[1, 2], "CustomerID"] = "CUST_0"
    rows = va.check_duplicates(spark.createDataFrame(valid)).collect()
    assert rows[0]["status"] == "warning" and rows[0]["details"] == '{"duplicate_count": 2}'


def test_null_ids_count_as_one_value(spark, valid):
    valid.loc[[1, 2, 3], "CustomerID"] = None
    rows = va.check_duplicates(spark.createDataFrame(valid)).collect()
    assert rows[0]["details"] == '{"duplicate_count": 2}'


def test_report_sections(spark, valid):
    text = va.report_text(va.run_checks(spark.createDataFrame(valid)))
    for part in ("DATA VALIDATION REPORT", "SUMMARY", "Passed:"):
        assert part in text


def test_no_columns_and_no_rows(spark):
    empty = spark.createDataFrame([], "struct<>")
    assert not va.verdict(va.run_checks(empty)).first()["passed"]
    no_rows = spark.createDataFrame([], CUSTOMER_SCHEMA)
    found = {r["check_name"]: r["status"] for r in va.run_checks(no_rows).collect()}
    assert found["target_balance"] == "failed" and found["missing_values"] == "passed"


def test_all_wrong_values_are_listed(spark, valid):
    valid["Gender"] = [f"g{i:03d}" for i in range(len(valid) - 2)] + ["it's", 'a "b"']
    df = spark.createDataFrame(valid)
    row = va.check_categories(df).filter(F.col("check_name").endswith("Gender")).first()
    assert row["message"] == f"Invalid values in Gender: {sorted(valid['Gender'])}"
    assert json.loads(row["details"]) == {"invalid_values": sorted(valid["Gender"])}
    assert va.invalid_values(df).count() == 100


def test_rows_are_quarantined(spark, valid):
    valid.loc[0, "Age"] = 17
    valid.loc[1, "Gender"] = None
    good, bad = va.split_valid(spark.createDataFrame(valid))
    assert good.count() == 98
    reasons = {r["CustomerID"]: r["errors"] for r in bad.collect()}
    assert reasons == {"CUST_0": ["Age: out of [18, 100]"], "CUST_1": ["Gender: missing"]}


def test_validate_path(spark, valid, tmp_path):
    valid.to_csv(tmp_path / "x.csv", index=False)
    ok, text = validate_path(spark, str(tmp_path / "x.csv"))
    assert ok and "Total Checks: 15" in text
    valid.drop(columns=["Age"]).to_csv(tmp_path / "y.csv", index=False)
    assert not validate_path(spark, str(tmp_path / "y.csv"))[0]
