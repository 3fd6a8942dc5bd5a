"""Boosted trees against brute-force searches on the same rows."""

import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from holdfast.plans import boosting
from holdfast.plans.boosting import UNIT, BoostedModel, Booster


def rows(n=500, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(1), rng.integers(0, 2, n),
                         rng.integers(0, 30, n) / 3.0])
    drive = 0.4 * x[:, 0] * x[:, 2] + np.sin(2 * x[:, 1]) - 0.15 * x[:, 3] + rng.normal(size=n)
    weight = rng.integers(1, 4, n).astype(float)
    return x, (drive > 0.3).astype(float), weight


@pytest.fixture(scope="module")
def data(spark):
    x, y, w = rows()
    return spark.createDataFrame(
        [(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)],
        ["features", "label", "w"]
    ).repartition(3)


class Brute:
    """The same trees, grown by trying every leaf, feature and value."""

    def __init__(self, x, y, w, lam=1.0, alpha=0.0, gamma=0.0, min_weight=1.0, min_rows=1):
        self.x, self.y, self.w = x, y, w
        self.lam, self.alpha, self.gamma = lam, alpha, gamma
        self.min_weight, self.min_rows = min_weight, min_rows

    def soft(self, g):
        return np.sign(g) * max(abs(g) - self.alpha, 0)

    def score(self, at):
        return self.soft(self.g[at].sum()) ** 2 / (self.h[at].sum() + self.lam)

    def best(self, at):
        found = (1e-12, None)
        for j in range(self.x.shape[1]):
            for v in np.unique(self.x[:, j])[:-1]:
                left, right = at[self.x[at, j] <= v], at[self.x[at, j] > v]
                if min(len(left), len(right)) < max(1, self.min_rows) or min(
                        self.h[left].sum(), self.h[right].sum()) < self.min_weight:
                    continue
                gain = (self.score(left) + self.score(right) - self.score(at)) / 2 - self.gamma
                if gain > found[0] + 1e-9:
                    found = (gain, (j, v, left, right))
        return found

    def fit(self, n_trees, depth, leaves, step):
        margin, out = np.zeros(len(self.y)), []
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            self.g = np.rint(self.w * (p - self.y) * UNIT) / UNIT
            self.h = np.rint(self.w * p * (1 - p) * UNIT) / UNIT
            open_, gains = [(np.arange(len(self.y)), 0)], []
            splits = [self.best(open_[0][0])]
            while True:
                can = [i for i, s in enumerate(splits) if s[1] and open_[i][1] < depth]
                if not can or (leaves and len(open_) >= leaves):
                    break
                i = max(can, key=lambda i: splits[i][0])
                gain, (j, v, left, right) = splits.pop(i)
                _, d = open_.pop(i)
                gains.append((j, v, gain))
                for side in (left, right):
                    open_.append((side, d + 1))
                    splits.append(self.best(side))
            for at, _ in open_:
                margin[at] -= step * self.soft(self.g[at].sum()) / (self.h[at].sum() + self.lam)
            out.append((sorted(gains), sorted(len(at) for at, _ in open_)))
        return margin, out


CASES = {
    "plain": ({}, {}),
    "penalties": ({"regLambda": 2.5, "regAlpha": 3.0, "gamma": 0.7}, {"lam": 2.5, "alpha": 3.0,
                                                                     "gamma": 0.7}),
    "sides": ({"minChildWeight": 20.0, "minInstancesPerNode": 25}, {"min_weight": 20.0, "min_rows": 25}),
    "leaves": ({"maxDepth": 9, "numLeaves": 7}, {}),
    "many leaves": ({"maxDepth": 4, "numLeaves": 100, "minChildWeight": 0.5}, {"min_weight": 0.5}),
}


@pytest.mark.parametrize("case", CASES)
def test_trees_equal_brute_force(spark, data, monkeypatch, case):
    monkeypatch.setattr(boosting, "STATE_TREES", 1)
    monkeypatch.setattr(boosting, "CHUNK", 17)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 64)
    params, plain = CASES[case]
    params = {"maxDepth": 3, **params}
    model = Booster(maxIter=2, stepSize=0.3, weightCol="w", **params).fit(data)
    x, y, w = rows()
    margin, trees = Brute(x, y, w, **plain).fit(2, params["maxDepth"], params.get("numLeaves", 0), 0.3)
    assert len(model.tree_list()) == 2
    for t, (gains, sizes) in zip(model.tree_list(), trees):
        got = sorted((t["feature"][i], t["threshold"][i], t["gain"][i]) for i in t["order"])
        assert [g[:2] for g in got] == [g[:2] for g in gains]
        assert np.allclose([g[2] for g in got], [g[2] for g in gains], atol=1e-6)
        leaf = [n for n, left in zip(t["cover"], t["left"]) if left < 0]
        assert sorted(leaf) == sizes
        if params.get("numLeaves"):
            assert len(leaf) <= params["numLeaves"]
    assert np.allclose(boosting.margin_of(model.tree_list(), x), margin, atol=1e-5)


def test_leaves_are_split_best_first(data):
    """A leaf's gain is never below the gain of a leaf that was open and is split later."""
    model = Booster(maxIter=1, maxDepth=8, numLeaves=12).fit(data)
    (t,) = model.tree_list()
    split = {n: i for i, n in enumerate(t["order"])}
    parent = {c: n for n in t["order"] for c in (t["left"][n], t["right"][n])}
    assert sum(left < 0 for left in t["left"]) <= 12 < len(t["left"])
    for a in t["order"]:
        for b in t["order"]:
            open_then = b == 0 or split[parent[b]] < split[a]
            if split[b] > split[a] and open_then:
                assert t["gain"][a] >= t["gain"][b]


def test_model_scores_and_saves(spark, data, tmp_path):
    booster = Booster(maxIter=8, maxDepth=3, stepSize=0.3, subsamplingRate=0.8, featureFraction=0.75)
    model = booster.fit(data)
    scored = model.transform(data).collect()
    right = np.mean([r["prediction"] == r["label"] for r in scored])
    assert right > 0.8
    for r in scored:
        assert 0 <= r["probability"][1] <= 1 and r["rawPrediction"][1] == -r["rawPrediction"][0]
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    model.write().overwrite().save(f"{tmp_path}/m")
    again = BoostedModel.load(f"{tmp_path}/m").transform(data).collect()
    assert [r["probability"] for r in again] == [r["probability"] for r in scored]
    assert booster.fit(data).getOrDefault("trees") == model.getOrDefault("trees")


def test_odd_rows(spark):
    one = spark.createDataFrame([(Vectors.dense([1.0, float("nan")]), 1.0)] * 5, ["features", "label"])
    (t,) = Booster(maxIter=1).fit(one).tree_list()
    assert t["left"] == [-1] and t["cover"] == [5] and t["value"][0] > 0
    holes = spark.createDataFrame(
        [(Vectors.dense([float("nan") if i % 2 else i % 4, 0.0]), float(i % 2)) for i in range(40)]
        + [(Vectors.dense([0.0, 0.0]), None)], ["features", "label"])
    model = Booster(maxIter=5, minChildWeight=0.0).fit(holes)
    got = model.transform(holes.dropna()).collect()
    assert len(got) == 40 and all(r["prediction"] == r["label"] for r in got)
    with pytest.raises(ValueError):
        Booster().fit(holes.where("label > 5"))
    assert json.loads(model.getOrDefault("trees"))[0]["cover"][0] == 40


def test_many_values_use_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    frame = spark.createDataFrame([(Vectors.dense([v]), float(v > 0.5)) for v in x], ["features", "label"])
    (edges,) = boosting.bin_edges(frame, "features", 64)
    assert 50 <= len(edges) <= 63 and edges == sorted(edges)
    (t,) = Booster(maxIter=1, maxDepth=1, maxBins=64).fit(frame).tree_list()
    assert abs(t["threshold"][0] - 0.5) < 0.1


def test_each_tree_is_applied_once(spark, monkeypatch):
    """The blocks carry the margin after every tree; passes do not go through earlier trees again."""
    applied, whole = [], boosting.advanced
    monkeypatch.setattr(boosting, "advanced", lambda rows, trees, width: applied.append(len(trees))
                        or whole(rows, trees, width))
    rows = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 > 3))
                                  for i in range(200)], ["features", "label"])
    model = boosting.Booster(maxIter=5, maxDepth=2).fit(rows)
    assert len(model.tree_list()) == 5 and applied == [1] * 4


def test_forests_keep_nodes_of_rows(spark):
    """The trees are those of a forest that walks from the root."""
    from holdfast.plans import models as md
    rows = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 > 3))
                                  for i in range(200)], ["features", "label"])
    kept, plain = md.rf(numTrees=3, maxDepth=4), md.rf(numTrees=3, maxDepth=4, cacheNodeIds=False)
    assert kept.getCacheNodeIds()
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.fit(rows).trees] == [
        t.toDebugString.split("\n", 1)[1] for t in plain.fit(rows).trees]
