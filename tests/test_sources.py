import pytest

from holdfast.sources import readers as rd, sinks as sk
from holdfast.plans import results as res
from conftest import customers

FULL = "Age INT, Tenure INT, `Total Spend` DOUBLE"


def parsed(spark, *bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    return [tuple(r) for r in rd.parse_json_rows(df, "body", FULL).drop("body").collect()]


def test_object_and_array(spark):
    assert parsed(spark, '{"Age": 35, "Tenure": 12, "Total Spend": 1000.5}') == [
        (None, 0, 35, 12, 1000.5)
    ]
    rows = parsed(spark, '[{"Age":25,"Tenure":6},{"Age":35,"Tenure":12},{"Age":45,"Tenure":24}]')
    assert [r[2] for r in rows] == [25, 35, 45]
    assert parsed(spark, "[]") == []


@pytest.mark.parametrize("body", ["17", '"text"', '{"Age": ', "[1, 2]", "", None, "null"])
def test_other_shapes_are_rejected(spark, body):
    rows = parsed(spark, body)
    assert len(rows) == 1 and rows[0][0] == rd.BAD_BODY


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("25,6,10,1,0,500,7\n35,12,20,2,5,1000,14\n")
    df = rd.read_positional(spark, str(tmp_path / "x.csv"), ", ".join(f"c{i} INT" for i in range(7)))
    assert (df.count(), len(df.columns)) == (2, 7)


def test_training_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        rd.read_training_dir(spark, str(tmp_path))
    customers(3).to_csv(tmp_path / "a.csv", index=False)
    customers(5).to_csv(tmp_path / "b_Processed.csv", index=False)
    assert rd.read_training_dir(spark, str(tmp_path)).count() == 5
    customers(7).to_csv(tmp_path / "b_churn.csv", index=False)
    assert rd.read_training_dir(spark, str(tmp_path), prefer=("churn",)).count() == 7


def test_clean_copy_is_made_once(spark, tmp_path):
    pdf = customers(10)
    pdf.loc[0, "Gender"] = None
    path = str(tmp_path / "clean")
    sk.materialize_clean(spark.createDataFrame(pdf), path)
    sk.materialize_clean(spark.createDataFrame(customers(50)), path)
    assert spark.read.parquet(path).count() == 9


def test_object_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"0" * 1048576)
    row = rd.list_objects(spark, str(tmp_path)).first()
    assert (row["name"], row["bytes"], row["size_mb"]) == ("x.bin", 1048576, 1.0)


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    metrics = spark.createDataFrame([(0.9, 0.8)], "accuracy double, f1 double")
    for run in ("a", "b"):
        sk.log_run(res.run_rows(metrics, "exp", run, {"depth": 3}), path)
    got = spark.read.parquet(path)
    assert got.count() == 6 and got.select("run_id").distinct().count() == 2


def test_processed_parquet(spark, tmp_path):
    sk.write_processed(spark.createDataFrame(customers(4)), str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
