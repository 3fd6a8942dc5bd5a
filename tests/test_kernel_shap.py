"""Kernel-weighted attributions against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.plans import attribution as at

COLS = ["a", "b", "c", "d", "e"]


def score(df):
    return df.withColumn("p", F.col("a") * F.col("b") + F.greatest("c", F.col("d")) - 0.3 * F.col("e")
                         * F.col("a") * F.col("c"))


def value(x):
    return x[0] * x[1] + max(x[2], x[3]) - 0.3 * x[4] * x[0] * x[2]


def shapley(x, background):
    n = len(x)
    v = {}
    for k in range(n + 1):
        for s in itertools.combinations(range(n), k):
            v[s] = np.mean([value([x[i] if i in s else b[i] for i in range(n)]) for b in background])
    phi = []
    for i in range(n):
        total = 0.0
        for s in v:
            if i not in s:
                total += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (
                    v[tuple(sorted((*s, i)))] - v[s])
        phi.append(total)
    return phi, v[()]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(6)
    x, b = rng.normal(size=(7, 5)), rng.normal(size=(4, 5))
    make = lambda rows, tag: spark.createDataFrame(
        [(f"{tag}{i}", *map(float, r)) for i, r in enumerate(rows)], ["CustomerID", *COLS])
    return x, b, make(x, "x"), make(b, "b")


def test_exact_with_all_coalitions(frames):
    x, b, rows, background = frames
    got = {(r["row_id"], r["feature"]): r["shap"] for r in at.kernel_shap(
        rows, score, background, COLS).collect()}
    assert len(got) == 7 * 6
    for i, row in enumerate(x):
        phi, base = shapley(row, b)
        assert got[f"x{i}", "(base)"] == pytest.approx(base, abs=1e-9)
        assert [got[f"x{i}", c] for c in COLS] == pytest.approx(phi, abs=1e-9)


def test_drawn_coalitions_add_up_and_come_near(frames):
    x, b, rows, background = frames
    got = {(r["row_id"], r["feature"]): r["shap"] for r in at.kernel_shap(
        rows, score, background, COLS, n=24).collect()}
    for i, row in enumerate(x):
        phi, base = shapley(row, b)
        assert sum(got[f"x{i}", c] for c in COLS) + base == pytest.approx(value(row), abs=1e-9)
        assert np.abs(np.array([got[f"x{i}", c] for c in COLS]) - phi).max() < 1.0


def test_coalitions():
    z, w = at.coalitions(6, 1000)
    assert len(z) == 2**6 - 2 and len({tuple(r) for r in z}) == len(z)
    assert w.sum() == pytest.approx(sum(5 / (k * (6 - k)) for k in range(1, 6)))
    z, w = at.coalitions(12, 200)
    assert len(z) <= 200 and w.min() > 0 and sorted(set(z.sum(axis=1)))[:1] == [1.0]
    assert {tuple(r) for r in z} == {tuple(1 - r) for r in z}
    assert w.sum() == pytest.approx(sum(11 / (k * (12 - k)) for k in range(1, 12)))


def test_one_feature(spark):
    frame = spark.createDataFrame([("x", 3.0), ("y", 1.0)], ["CustomerID", "a"])
    got = at.kernel_shap(frame, lambda d: d.withColumn("p", 2 * F.col("a")), frame, ["a"]).collect()
    assert sorted((r["row_id"], r["feature"], round(r["shap"], 9)) for r in got) == [
        ("x", "(base)", 4.0), ("x", "a", 2.0), ("y", "(base)", 4.0), ("y", "a", -2.0)]
