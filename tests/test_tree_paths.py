"""Attributions from tree paths against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.plans import models as md, tree_paths as tp
from holdfast.plans.boosting import Booster, margin_of


def drawn(rng, width, depth):
    """A tree with random splits and covers; features repeat on paths."""
    t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def add(level, cover):
        n = len(t["feature"])
        for k, v in zip(t, (-1, 0.0, -1, -1, float(rng.normal()), cover)):
            t[k].append(v)
        if level and cover > 2 and rng.random() < 0.9:
            t["feature"][n], t["threshold"][n] = int(rng.integers(width)), float(rng.normal())
            part = int(rng.integers(1, cover))
            t["left"][n] = add(level - 1, part)
            t["right"][n] = add(level - 1, cover - part)
        return n

    add(depth, 500)
    return t


def expected(t, x, known, node=0):
    """Value of a tree when only the features ``known`` of a row are."""
    if t["left"][node] < 0:
        return t["value"][node]
    f = t["feature"][node]
    sides = [t["left"][node], t["right"][node]]
    if f in known:
        return expected(t, x, known, sides[0 if x[f] <= t["threshold"][node] else 1])
    return sum(t["cover"][s] / t["cover"][node] * expected(t, x, known, s) for s in sides)


def by_subsets(trees, x, width):
    """Shapley values and interactions from all subsets."""
    value = {frozenset(s): sum(expected(t, x, frozenset(s)) for t in trees)
             for k in range(width + 1) for s in itertools.combinations(range(width), k)}
    phi, pair = np.zeros(width), np.zeros((width, width))
    for s, v in value.items():
        k = len(s)
        for i in set(range(width)) - s:
            phi[i] += math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) * (
                value[s | {i}] - v)
            for j in set(range(width)) - s - {i}:
                pair[i, j] += math.factorial(k) * math.factorial(width - k - 2) / (
                    2 * math.factorial(width - 1)) * (value[s | {i, j}] - value[s | {i}]
                                                      - value[s | {j}] + v)
    return phi, pair


@pytest.mark.parametrize("cells", [1 << 20, 50])
def test_equals_all_subsets(monkeypatch, cells):
    monkeypatch.setattr(tp, "CELLS", cells)
    rng = np.random.default_rng(3)
    width = 8
    trees = [drawn(rng, width, 6) for _ in range(4)] + [drawn(rng, width, 0)]
    base, table = tp.path_table(trees)
    x = rng.normal(size=(6, width))
    phi, pairs = tp.shap_values(x, table), tp.interaction_values(x, table)
    for r in range(len(x)):
        want, want_pairs = by_subsets(trees, x[r], width)
        assert np.allclose(phi[r], want, atol=1e-9)
        off = ~np.eye(width, dtype=bool)
        assert np.allclose(pairs[r][off], want_pairs[off], atol=1e-9)
    assert np.allclose(pairs.sum(axis=2), phi, atol=1e-9)
    assert np.allclose(phi.sum(axis=1) + base, margin_of(trees, x), atol=1e-9)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", *map(float, x), float(x[0] * x[1] > 2 or x[2] > 6)) for i, x in enumerate(
        rng.integers(0, 9, (300, 4)))]
    return spark.createDataFrame(rows, ["CustomerID", "a", "b", "c", "d", "label"])


@pytest.mark.parametrize("make,score", [
    (lambda: Booster(maxIter=4, maxDepth=3), "rawPrediction"),
    (lambda: md.rf(numTrees=5, maxDepth=4), "probability"), (md.tree, "probability"),
    (lambda: md.gbt(maxIter=4, maxDepth=3), "rawPrediction")])
def test_models_add_up(frame, make, score):
    assemble = VectorAssembler(inputCols=list("abcd"), outputCol="features")
    model = make().fit(assemble.transform(frame))
    fitted = md.Fitted("x", PipelineModel([assemble, model]), list("abcd"))
    scored = {r["CustomerID"]: r for r in fitted.pipeline.transform(frame).collect()}
    total, by_row = {}, {}
    for r in tp.tree_shap(frame, fitted).collect():
        total[r["row_id"]] = total.get(r["row_id"], 0.0) + r["shap"]
        by_row.setdefault(r["row_id"], {})[r["feature"]] = r["shap"]
    assert len(total) == 300
    for k, r in scored.items():
        want = r[score][1]
        assert abs(total[k] - want) < 1e-9
    pairs = {}
    for r in tp.tree_interactions(frame.limit(20), fitted).collect():
        share = 1.0 if r["feature_1"] == r["feature_2"] else 0.5
        for f in {r["feature_1"], r["feature_2"]}:
            key = r["row_id"], f
            pairs[key] = pairs.get(key, 0.0) + share * r["interaction"]
    for (row, f), v in pairs.items():
        assert abs(v - by_row[row][f]) < 1e-9
    strength = tp.interaction_strength(frame, fitted, 10).collect()
    assert len(strength) == 6 and all(r["interaction_strength"] >= 0 for r in strength)


@pytest.mark.parametrize("bits", [2, 5, 11])
def test_tables_of_groups_equal_the_paths(monkeypatch, bits):
    """Tables of any size give the values of all paths, also for NaN and values on a threshold."""
    monkeypatch.setattr(tp, "CHUNK", 70)
    rng = np.random.default_rng(5)
    trees = [drawn(rng, 8, 7) for _ in range(4)] + [drawn(rng, 8, 0), drawn(rng, 8, 1)]
    for t in trees:
        t["threshold"] = [round(v, 1) for v in t["threshold"]]
    x = np.round(rng.normal(size=(200, 8)), 1)
    x[::5, 3] = np.nan
    want = tp.shap_values(x, tp.path_table(trees)[1])
    assert np.allclose(tp.grouped_shap_values(x, trees, bits), want, atol=1e-12)


def test_integrals_do_not_grow_with_rows(monkeypatch):
    """Many rows look their sums up; integrals are taken once per leaf and answer."""
    rng = np.random.default_rng(6)
    trees = [drawn(rng, 6, 6) for _ in range(3)]
    seen, whole = [], tp._shares
    monkeypatch.setattr(tp, "_shares", lambda inside, *rest: seen.append(inside.size) or whole(
        inside, *rest))
    tp.grouped_shap_values(rng.normal(size=(600, 6)), trees)
    few = sum(seen)
    tp.grouped_shap_values(rng.normal(size=(60_000, 6)), trees)
    assert few and sum(seen) == 2 * few


def test_many_rows_go_through_tables(monkeypatch, frame):
    """Rows of a task share tables, in several rounds, and add up to the score."""
    for name, value in (("FEW", 1), ("ROWS", 40), ("shap_values", None)):
        monkeypatch.setattr(tp, name, value)
    assemble = VectorAssembler(inputCols=list("abcd"), outputCol="features")
    fitted = md.Fitted("x", PipelineModel([assemble, md.rf(numTrees=5, maxDepth=4).fit(
        assemble.transform(frame))]), list("abcd"))
    total = {r["row_id"]: r["t"] for r in tp.tree_shap(frame, fitted).groupBy("row_id").agg(
        F.sum("shap").alias("t")).collect()}
    scored = fitted.pipeline.transform(frame).collect()
    assert len(total) == len(scored) == 300
    assert all(abs(total[r["CustomerID"]] - r["probability"][1]) < 1e-9 for r in scored)


def test_other_models_are_refused(frame):
    assemble = VectorAssembler(inputCols=["a"], outputCol="features")
    with pytest.raises(ValueError):
        tp.trees_of(md.logreg().fit(assemble.transform(frame)))
