"""Second-order gradient boosting of trees, level by level or leaf by leaf.

Every pass over the rows adds up gradients and hessians of the logistic loss per node, feature and
bin. With L1 weight ``alpha`` and L2 weight ``lambda`` a leaf with sums G and H has the value
``-soft(G, alpha) / (H + lambda)``, and a split gains half the growth of ``soft(G, alpha)^2 / (H + lambda)``,
less ``gamma``. Sides need ``minChildWeight`` of hessian and ``minInstancesPerNode`` rows.

Leaves are split best first, until ``numLeaves`` are reached, no leaf gains, or all are ``maxDepth`` deep;
without a limit of leaves that is growth by level. A pass prepares the children of all leaves that
could be split next, so there are about as many passes as levels. Of two children only the smaller one
is summed; the other is the difference to the parent.

Rows are kept in blocks of binned features, with the margin after the trees so far: each tree is applied once,
not in every pass over the rows. Blocks are written from time to time, so a lost executor repeats few trees.
Sums are whole numbers (units of 2^-24), so results do not depend on the order of rows. The driver holds sums of
the leaves of one tree: at most ``numLeaves`` x features x bins.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
    HasRawPredictionCol, HasSeed, HasStepSize, HasWeightCol,
)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Unit of the sums.
UNIT = 1 << 24
#: Rows of a block, trees after which blocks are written, and bins whose sums travel together.
BLOCK_ROWS, STATE_TREES, CHUNK = 1 << 16, 20, 4096
#: Feature columns of one statement that looks for bin edges.
EDGE_COLUMNS = 32


# ---- bins ------------------------------------------------------------------------------------
def bin_edges(data: DataFrame, features: str = "features", max_bins: int = 256) -> list[list[float]]:
    """Upper edges of each feature's bins; a value belongs to the first edge that is not below it.

    A feature of few values has a bin for each one, others have quantiles. NaN has the last bin.
    """
    width = len(data.select(features).first()[0])
    rows = data.select(vector_to_array(features).alias("x"))
    edges: list[list[float]] = []
    for start in range(0, width, EDGE_COLUMNS):
        at = range(start, min(width, start + EDGE_COLUMNS))
        cells = [F.nanvl(F.col("x")[j], F.lit(None)) for j in at]
        steps = [i / max_bins for i in range(1, max_bins)]
        found = rows.agg(
            *[F.percentile_approx(c, steps, 50 * max_bins).alias(f"q{j}") for j, c in zip(at, cells)],
            *[F.approx_count_distinct(c).alias(f"d{j}") for j, c in zip(at, cells)],
            *[F.max(F.when(F.col("x")[j].isNotNull() & c.isNull(), 1)).alias(f"nan{j}")
              for j, c in zip(at, cells)],
            *[F.max(c).alias(f"m{j}") for j, c in zip(at, cells)]).first()
        few = [j for j in at if found[f"d{j}"] <= max_bins]
        values: dict[int, list[float]] = {j: [] for j in few}
        if few:
            pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col("x")[j].alias("v")) for j in few])
            for r in rows.select(F.inline(pairs)).where("NOT isnan(v)").distinct().collect():
                values[r["j"]].append(r["v"])
        for j in at:
            own = sorted(values.get(j, ()))
            if j not in values or len(own) > max_bins:
                own = sorted(set(found[f"q{j}"] or ()))
            else:
                own = own[:-1]
            if found[f"nan{j}"] and found[f"m{j}"] is not None:  # what is above all values is NaN
                own = [*own, found[f"m{j}"]][-(max_bins - 1):]
            edges.append(own)
    return edges


def blocks(data: DataFrame, edges: list[list[float]], features: str, label: str,
           weight: str | None, margin: float) -> DataFrame:
    """Rows in blocks: block, bins (a byte for each row and feature), label, weight, margin."""
    cuts = [np.asarray(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def given() -> pa.RecordBatch:
            x = np.concatenate([h[0] for h in held])
            bins = np.empty(x.shape, np.uint8)
            for j, c in enumerate(cuts):
                bins[:, j] = np.searchsorted(c, x[:, j], "left")  # NaN comes last
            cells = [bins, *(np.concatenate([h[i] for h in held]) for i in (1, 2)),
                     np.full(len(x), margin)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([c.tobytes()], pa.binary()) for c in cells],
                ["bins", "label", "weight", "margin"])

        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append((flat.reshape(b.num_rows, len(cuts)), *(
                b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))))
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield given()
                rows = 0
        if rows:
            yield given()

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return data.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"),
                       w.alias("weight")).mapInArrow(
        run, "bins binary, label binary, weight binary, margin binary").withColumn(
        "block", F.monotonically_increasing_id())


# ---- trees -----------------------------------------------------------------------------------
class Tree:
    """Nodes as lists; a node without children has ``left`` -1. ``cut`` is the last bin on the left."""

    PARTS = ("feature", "cut", "left", "right", "g", "h", "n", "gain", "depth")

    def __init__(self, **parts):
        for part in self.PARTS:
            setattr(self, part, parts.get(part, []))

    def add(self, g: int, h: int, n: int, depth: int) -> int:
        for part, value in zip(self.PARTS, (-1, -1, -1, -1, g, h, n, 0.0, depth)):
            getattr(self, part).append(value)
        return len(self.feature) - 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = (np.asarray(getattr(self, p)) for p in self.PARTS[:4])
        at = np.zeros(len(bins), np.int64)
        moving = np.arange(len(bins))
        while len(moving):
            moving = moving[left[at[moving]] >= 0]
            node = at[moving]
            go_left = bins[moving, feature[node]] <= cut[node]
            at[moving] = np.where(go_left, left[node], right[node])
        return at


def soft(g, alpha: float):
    """Gradient sum after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


class Splits:
    """The search for splits in sums of gradients, hessians and rows by bin."""

    def __init__(self, edges, reg_lambda, reg_alpha, gamma, min_weight, min_rows):
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.slots = int(self.sizes.sum())
        self.feature_of = np.repeat(np.arange(len(edges)), self.sizes)
        self.reg_lambda, self.reg_alpha, self.gamma = reg_lambda, reg_alpha, gamma
        self.min_weight, self.min_rows = min_weight, min_rows

    def score(self, g, h):
        return soft(g, self.reg_alpha) ** 2 / np.maximum(h + self.reg_lambda, 1e-12)

    def value(self, g: int, h: int) -> float:
        """Value of a leaf."""
        return float(-soft(g / UNIT, self.reg_alpha) / max(h / UNIT + self.reg_lambda, 1e-12))

    def best(self, sums: np.ndarray, allowed: np.ndarray) -> tuple | None:
        """Gain, feature, cut, and sums of the left side; the first of equal ones."""
        total = sums[:, :self.sizes[0]].sum(axis=1)
        running = np.cumsum(sums, axis=1)
        before = np.where(self.offsets > 0, running[:, self.offsets - 1], 0)
        left = running - np.repeat(before, self.sizes, axis=1)
        right = total[:, None] - left
        gl, hl, gr, hr = left[0] / UNIT, left[1] / UNIT, right[0] / UNIT, right[1] / UNIT
        gain = 0.5 * (self.score(gl, hl) + self.score(gr, hr)
                      - self.score(total[0] / UNIT, total[1] / UNIT)) - self.gamma
        fits = (hl >= self.min_weight) & (hr >= self.min_weight) & (
            np.minimum(left[2], right[2]) >= max(1, self.min_rows)) & allowed[self.feature_of]
        gain = np.where(fits, gain, -np.inf)
        at = int(np.argmax(gain))
        if not gain[at] > 1e-12:
            return None
        feature = int(self.feature_of[at])
        return float(gain[at]), feature, at - int(self.offsets[feature]), [int(x) for x in left[:, at]]


def _margins(bins, margin, trees: list) -> np.ndarray:
    out = margin.copy()
    for tree, value in trees:
        out += value[tree.place(bins)]
    return out


def _cells(b: pa.RecordBatch, width: int):
    """Blocks of a batch as arrays."""
    for row in zip(*(b.column(i) for i in range(5))):
        block = row[0].as_py()
        bins, label, weight, margin = (np.frombuffer(c.as_buffer(), t) for c, t in zip(
            row[1:], (np.uint8, float, float, float)))
        yield block, bins.reshape(len(label), width), label, weight, margin


_BLOCK = ["block", "bins", "label", "weight", "margin"]


def node_sums(rows: DataFrame, splits: Splits, tree: Tree, wanted: list[int],
              sample: float = 1.0, seed: int = 0, parts: int = 2) -> dict[int, np.ndarray]:
    """Sums of gradients, hessians and rows by bin, for each of the ``wanted`` nodes.

    ``rows`` is read by ``parts`` tasks; the sums of one task need no exchange.
    """
    width, slots = len(splits.sizes), splits.slots
    offsets, number = splits.offsets, {node: k for k, node in enumerate(wanted)}
    chunks = -(-slots // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.full(len(tree.feature), -1)
        which[list(number)] = list(number.values())
        total = np.zeros((3, len(number) * slots), np.int64)
        for b in batches:
            for block, bins, label, weight, margin in _cells(b, width):
                k = which[tree.place(bins)]
                if sample < 1.0:
                    k[np.random.default_rng([seed, block]).random(len(k)) >= sample] = -1
                at = np.flatnonzero(k >= 0)
                p = 1 / (1 + np.exp(-margin[at]))
                w = weight[at]
                slot = (k[at, None] * slots + offsets + bins[at]).ravel()
                for i, x in enumerate((w * (p - label[at]), w * p * (1 - p))):
                    total[i] += np.bincount(slot, np.repeat(np.rint(x * UNIT), width),
                                            total.shape[1]).astype(np.int64)
                total[2] += np.bincount(slot, minlength=total.shape[1])
        total = total.reshape(3, len(number), slots)
        keys = [(k, c) for k in range(len(number)) for c in range(chunks)]
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()),
            pa.array([total[:, k, c * CHUNK:(c + 1) * CHUNK].tobytes() for k, c in keys], pa.binary()),
        ], ["node", "chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for node, chunk, sums in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(sums, np.int64)
                total[node, chunk] = total[node, chunk] + x if (node, chunk) in total else x
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
            pa.array([x.tobytes() for x in total.values()], pa.binary())], ["node", "chunk", "sums"])

    schema = "node int, chunk int, sums binary"
    found = rows.mapInArrow(run, schema)
    if parts > 1:
        found = found.repartition("node", "chunk").mapInArrow(add, schema)
    out = {node: np.zeros((3, slots), np.int64) for node in wanted}
    for r in found.collect():
        at = r["chunk"] * CHUNK
        x = np.frombuffer(r["sums"], np.int64).reshape(3, -1)
        out[wanted[r["node"]]][:, at:at + x.shape[1]] += x
    return out


def grow(rows: DataFrame, splits: Splits, max_depth: int, num_leaves: int,
         allowed: np.ndarray, sample: float = 1.0, seed: int = 0, parts: int = 2) -> Tree:
    """One tree, best leaf first."""
    tree, trial = Tree(), Tree()
    trial.add(0, 0, 0, 0)
    sums = node_sums(rows, splits, trial, [0], sample, seed, parts)
    g, h, n = (int(x) for x in sums[0][:, :splits.sizes[0]].sum(axis=1))
    tree.add(g, h, n, 0)
    limit = num_leaves if num_leaves > 0 else sys.maxsize
    # split of each leaf that gains, and its children once they are summed; -1 needs no sums
    best: dict[int, tuple] = {}
    children: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
    queue: list[tuple[float, int]] = []

    def consider(node: int, total: np.ndarray | None) -> None:
        if total is None or tree.depth[node] >= max_depth:
            return
        split = splits.best(total, allowed)
        if split:
            best[node] = split
            heapq.heappush(queue, (-split[0], node))
            sums[node] = total

    def prepare(leaves: int) -> None:
        """Sums the children of all leaves that could be split next."""
        nodes = [n for _, n in heapq.nsmallest(limit - leaves, queue) if n not in children]
        for node in [n for n in nodes if tree.depth[n] + 1 >= max_depth]:
            children[node] = None
        nodes = [n for n in nodes if n not in children]
        if not nodes:
            return
        trial = Tree(**{p: list(getattr(tree, p)) for p in Tree.PARTS})
        small = []
        for node in nodes:
            _, feature, cut, left = best[node]
            trial.feature[node], trial.cut[node] = feature, cut
            trial.left[node], trial.right[node] = (trial.add(0, 0, 0, 0) for _ in range(2))
            small.append(trial.left[node] if 2 * left[2] <= tree.n[node] else trial.right[node])
        found = node_sums(rows, splits, trial, small, sample, seed, parts)
        for node, child in zip(nodes, small):
            pair = found[child], sums[node] - found[child]
            children[node] = pair if child == trial.left[node] else pair[::-1]

    consider(0, sums[0])
    leaves = 1
    while queue and leaves < limit:
        node = queue[0][1]
        if node not in children and leaves + 1 < limit:
            prepare(leaves)
            continue
        heapq.heappop(queue)
        gain, feature, cut, left = best.pop(node)
        tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
        right = [a - b for a, b in zip((tree.g[node], tree.h[node], tree.n[node]), left)]
        tree.left[node], tree.right[node] = (tree.add(*s, tree.depth[node] + 1) for s in (left, right))
        for child, total in zip((tree.left[node], tree.right[node]),
                                children.pop(node, None) or (None, None)):
            consider(child, total)
        sums.pop(node)
        leaves += 1
    return tree


# ---- estimator and model ---------------------------------------------------------------------
class _BoosterParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol,
                     HasRawPredictionCol, HasMaxIter, HasStepSize, HasSeed):
    """Parameters of the booster and its model."""

    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree, 0 for any", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 weight of leaves", TypeConverters.toFloat)
    regAlpha = Param(Params._dummy(), "regAlpha", "L1 weight of leaves", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "gain a split must exceed", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a side",
                           TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a side",
                                TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a tree sees",
                            TypeConverters.toFloat)
    featureFraction = Param(Params._dummy(), "featureFraction", "share of features a tree sees",
                            TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 256 at most", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=6, numLeaves=0, regLambda=1.0, regAlpha=0.0,
                         gamma=0.0, minChildWeight=1.0, minInstancesPerNode=1, subsamplingRate=1.0,
                         featureFraction=1.0, maxBins=256, seed=42, rawPredictionCol="rawPrediction",
                         probabilityCol="probability", predictionCol="prediction")


class Booster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for labels 0 and 1, with leaf penalties and a limit of leaves.

    Sampled rows depend on how the rows are partitioned; all else does not. NaN counts as the highest
    value. Rows without label or with weight 0 are left out; without rows of both classes the trees
    are single leaves.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", **params):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        get = self.getOrDefault
        label = self.getLabelCol()
        weight = get("weightCol") if self.isDefined("weightCol") and get("weightCol") else None
        data = dataset.where(F.col(label).isNotNull())
        if weight:
            data = data.where(F.col(weight) > 0)
        n = data.count()
        if not n:
            raise ValueError("no rows to fit")
        edges = bin_edges(data, self.getFeaturesCol(), get("maxBins"))
        # no more tasks than blocks: passes are many and short
        rows = _kept(blocks(data.coalesce(-(-n // BLOCK_ROWS)), edges, self.getFeaturesCol(), label,
                            weight, 0.0))
        parts = rows.rdd.getNumPartitions()
        splits = Splits(edges, get("regLambda"), get("regAlpha"), get("gamma"), get("minChildWeight"),
                        get("minInstancesPerNode"))
        draw = np.random.default_rng(get("seed"))
        width = len(edges)
        seen = max(1, round(get("featureFraction") * width))
        trees, before = [], None
        for i in range(get("maxIter")):
            allowed = np.zeros(width, bool)
            allowed[draw.permutation(width)[:seen] if seen < width else slice(None)] = True
            tree = grow(rows, splits, get("maxDepth"), get("numLeaves"), allowed,
                        get("subsamplingRate"), int(draw.integers(2**31)), parts)
            if before is not None:     # all rows have the margin of the last tree by now
                before.unpersist()
            value = np.array([get("stepSize") * splits.value(g, h) if left < 0 else 0.0
                              for g, h, left in zip(tree.g, tree.h, tree.left)])
            trees.append({
                "feature": tree.feature, "left": tree.left, "right": tree.right, "gain": tree.gain,
                "cover": tree.n, "value": value.tolist(), "order": _order(tree),
                "threshold": [edges[f][c] if f >= 0 else 0.0
                              for f, c in zip(tree.feature, tree.cut)]})
            if i + 1 < get("maxIter"):
                before, rows = rows, advanced(rows, [(tree, value)], width)
                rows = rows.persist() if (i + 1) % STATE_TREES else _kept(rows)
        rows.unpersist()
        model = BoostedModel(trees=json.dumps(trees), numFeatures=width)
        return self._copyValues(model)


def _order(tree: Tree) -> list[int]:
    """Nodes with a split, in the order of growth."""
    return sorted((n for n, left in enumerate(tree.left) if left >= 0), key=lambda n: tree.left[n])


def _kept(rows: DataFrame) -> DataFrame:
    """Blocks as a written table, read into memory as far as it has room."""
    return staged(rows.select(*_BLOCK), "booster").persist()


def advanced(rows: DataFrame, trees: list, width: int) -> DataFrame:
    """Blocks with the margin after ``trees``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = [_margins(bins, margin, trees).tobytes()
                       for _, bins, _, _, margin in _cells(b, width)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(4)), pa.array(margins, pa.binary())], _BLOCK)

    return rows.mapInArrow(
        run, "block long, bins binary, label binary, weight binary, margin binary")


def margin_of(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' leaf values for rows of features."""
    out = np.zeros(len(x))
    for t in trees:
        feature, threshold, left, right, value = (np.asarray(t[k]) for k in (
            "feature", "threshold", "left", "right", "value"))
        at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(moving):
            moving = moving[left[at[moving]] >= 0]
            node = at[moving]
            go_left = x[moving, feature[node]] <= threshold[node]
            at[moving] = np.where(go_left, left[node], right[node])
        out += value[at]
    return out


class BoostedModel(Model, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees; adds ``rawPrediction`` (margins), ``probability`` and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "trees as JSON", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "width of the features", TypeConverters.toInt)

    def __init__(self, trees: str = "[]", numFeatures: int = 0):
        super().__init__()
        self._set(trees=trees, numFeatures=numFeatures)

    def tree_list(self) -> list[dict]:
        return json.loads(self.getOrDefault("trees"))

    @property
    def featureImportances(self):
        """Gain of each feature, as a share of all gain."""
        total = np.zeros(self.getOrDefault("numFeatures"))
        for t in self.tree_list():
            for feature, gain in zip(t["feature"], t["gain"]):
                if feature >= 0:
                    total[feature] += gain
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast(self.tree_list())

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(margin_of(sent.value, np.stack(x.to_numpy())))

        raw, probability, prediction = (self.getOrDefault(c) for c in (
            "rawPredictionCol", "probabilityCol", "predictionCol"))
        both = F.col("_margin")
        p = 1 / (1 + F.exp(-both))
        return dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol()))).withColumns({
            raw: array_to_vector(F.array(-both, both)),
            probability: array_to_vector(F.array(1 - p, p)),
            prediction: (p > 0.5).cast("double"),
        }).drop("_margin")
