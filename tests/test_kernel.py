import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from holdfast.plans import kernel, models as md


def rings(n=300, seed=1):
    rng = np.random.default_rng(seed)
    inner = rng.random(n) < 0.5
    radius = np.where(inner, 1.0, 3.0) + rng.normal(0, 0.2, n)
    turn = rng.uniform(0, 2 * np.pi, n)
    return np.column_stack([radius * np.cos(turn), radius * np.sin(turn)]), inner.astype(float)


@pytest.fixture(scope="module")
def frames(spark):
    x, y = rings()
    rows = [(Vectors.dense(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))]
    data = spark.createDataFrame(rows, ["features", "label", "i"]).coalesce(1)
    return data.where("i % 3 > 0"), data.where("i % 3 = 0")


def accuracy(model, test):
    got = model.transform(test).collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in got)
    return np.mean([r["prediction"] == r["label"] for r in got]), got


def test_kernel_parts_rings_that_a_line_cannot(frames):
    train, test = frames
    flat, _ = accuracy(md.linear_svm(maxIter=12).fit(train), test)
    assert flat < 0.7
    model = md.kernel_svm(maxIter=12, folds=2, dimensions=96).fit(train)
    curved, got = accuracy(model, test)
    assert curved > 0.95
    # probabilities are calibrated: their log loss is far below that of a coin
    loss = np.mean([-np.log(max(r["probability"][int(r["label"])], 1e-12)) for r in got])
    assert loss < 0.2
    again, _ = accuracy(md.kernel_svm(maxIter=12, folds=2, dimensions=96).fit(train), test)
    assert again == curved


@pytest.mark.parametrize("dimensions", [256, 4096])
def test_error_of_the_kernel(spark, dimensions):
    x, _ = rings(40)
    frame = spark.createDataFrame([(Vectors.dense(a), i) for i, a in enumerate(x)], ["features", "i"])
    rows = kernel.FourierMap(dimensions=dimensions, gamma=0.4).transform(frame).orderBy("i").collect()
    z = np.array([r["_kernel"].toArray() for r in rows])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    # four deviations for all pairs; one cosine product has a variance below one
    assert np.abs(z @ z.T - exact).max() < 6 / np.sqrt(dimensions)


def test_scale(spark):
    x, _ = rings(50)
    frame = spark.createDataFrame([(Vectors.dense(a),) for a in x], ["features"])
    assert kernel.scale(frame, "features") == pytest.approx(1 / (2 * x.var()))
    same = spark.createDataFrame([(Vectors.dense([1.0, 1.0]),)], ["features"])
    assert kernel.scale(same, "features") == 1.0


def test_model_is_saved(spark, frames, tmp_path):
    from pyspark.ml import PipelineModel
    train, test = frames
    model = md.make_model("svm", {"dimensions": 64, "C": 2.0, "folds": 2, "maxIter": 10}).fit(train)
    model.write().overwrite().save(f"{tmp_path}/m")
    a, _ = accuracy(model, test)
    b, _ = accuracy(PipelineModel.load(f"{tmp_path}/m"), test)
    assert a == b


def test_ridge_weight_is_a_parameter(spark, frames):
    from pyspark.ml.tuning import ParamGridBuilder
    train, _ = frames
    model = md.logreg()
    grid = ParamGridBuilder().addGrid(model.C, [1e-6, 10.0]).build()
    weak, strong = (m for _, m in sorted(model.fitMultiple(train, grid), key=lambda x: x[0]))
    assert np.abs(weak.coefficients.toArray()).max() < np.abs(strong.coefficients.toArray()).max()
    assert md.spark_params(model, {"C": 3.0}) == {model.C: 3.0}


def test_cosines_of_several_rounds(spark, monkeypatch):
    """A batch is one buffer, filled round by round; empty partitions give nothing."""
    monkeypatch.setattr(kernel, "ROWS", 3)
    x = np.random.default_rng(4).normal(size=(10, 2))
    data = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["i", "features"])
    both = kernel.FourierMap(dimensions=5, gamma=0.5, seed=1).transform(data.repartition(4).where("i <> 7"))
    w, b = kernel.directions(2, 5, 0.5, 1)
    got = {r["i"]: r["_kernel"].toArray() for r in both.collect()}
    assert sorted(got) == [i for i in range(10) if i != 7]
    assert all(np.allclose(got[i], np.sqrt(2 / 5) * np.cos(x[i] @ w + b), atol=1e-12) for i in got)
