"""Exact attributions and pair interactions of tree models, from the paths of their trees.

A leaf is reached when the row lies in the leaf's interval of every feature on its path. If a feature is
not known, the row goes both ways in the shares of the training rows; over a path these shares multiply
to one number for each feature. With ``o`` (0 or 1) for "inside" and ``z`` for the share, the leaf's part
of a Shapley value is ``value * (o_i - z_i) * integral over t of prod_j (z_j (1 - t) + o_j t)`` for all other
features j of the path: the weights of coalitions are the moments of t. The product has a degree below
the number of features, so Gauss-Legendre points give the integral exactly. Pairs are the same with
two factors taken out, and half the size.

The path table of all trees is sent to the tasks, which evaluate it for a batch of rows at a time; there
are no coalitions to draw and no permutations.

What a leaf adds depends only on which of its intervals hold the row. For many rows the leaves below a node
therefore share one table over all answers to their comparisons, at most ``2 ** BITS`` of them. A row looks up
its sum there, so its cost is a few array reads per node instead of the integral of every leaf.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.profile import q
from holdfast.plans.boosting import BoostedModel
from holdfast.schema import ID
from holdfast.session import run_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells (rows x leaves x features of a path) that a task works on at a time.
CELLS = 1 << 20
#: Comparisons whose answers make one table (16 at most), rows that share the tables, rows that are looked up
#: at a time, and the least rows that are worth tables.
BITS, ROWS, CHUNK, FEW = 11, 1 << 17, 1 << 15, 512


class Paths(NamedTuple):
    """Leaves whose paths have the same number of features."""

    feature: np.ndarray     # leaf, place on the path
    low: np.ndarray         # the row's value lies above,
    high: np.ndarray        # and not above
    share: np.ndarray
    value: np.ndarray       # leaf


def trees_of(model) -> list[dict]:
    """Trees as lists of nodes: feature, threshold, left, right, value, cover.

    The values add up to the margin of boosted trees, and to the probability of class 1 of a
    forest or a single tree.
    """
    if isinstance(model, BoostedModel):
        return model.tree_list()
    kinds = (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)
    if not isinstance(model, kinds):
        raise ValueError(f"no tree model: {type(model).__name__}")
    spark = SparkSession.getActiveSession()
    path = f"{run_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if isinstance(model, DecisionTreeClassificationModel):
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    nodes: dict[int, list] = {}
    for r in saved.collect():
        nodes.setdefault(r["treeID"], []).append(r["nodeData"])
    boosted = isinstance(model, GBTClassificationModel)
    weights = model.treeWeights if boosted else [1.0 / len(nodes)] * len(nodes)
    return [_nodes(sorted(nodes[i], key=lambda n: n["id"]), weights[i], boosted) for i in sorted(nodes)]


def _nodes(rows: list, weight: float, boosted: bool) -> dict:
    """Nodes of one of Spark's trees, as it saves them."""
    out = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}
    for r in rows:
        stats, split = r["impurityStats"], r["split"]
        if split["featureIndex"] >= 0 and split["numCategories"] != -1:
            raise ValueError("splits by categories are not supported")
        cover = stats[0] if boosted else sum(stats)
        value = r["prediction"] if boosted else stats[1] / cover if len(stats) > 1 else 0.0
        for k, v in zip(out, (split["featureIndex"], (split["leftCategoriesOrThreshold"] or [0.0])[0],
                              r["leftChild"], r["rightChild"], weight * value, cover)):
            out[k].append(v)
    return out


def path_table(trees: list[dict]) -> tuple[float, list[Paths]]:
    """Mean value over the training rows, and all leaves by the number of features on their path."""
    base, found = 0.0, {}
    for t in trees:
        waiting = [(0, {}, 1.0)]
        while waiting:
            node, path, reach = waiting.pop()
            if t["left"][node] < 0:
                base += t["value"][node] * reach
                found.setdefault(len(path), []).append((path, t["value"][node]))
                continue
            for child, there, _ in _children(t, node, path):
                waiting.append((child, there, reach * (t["cover"][child] / t["cover"][node])))
    return base, [p for size in sorted(found) for p in _packed(found[size])]


def _children(t: dict, node: int, path: dict) -> Iterator[tuple[int, dict, bool]]:
    """Children of a node with their paths (low, high and share by feature); the left one comes first."""
    f, cut = t["feature"][node], t["threshold"][node]
    low, high, z = path.get(f, (-np.inf, np.inf, 1.0))
    for child, left in ((t["left"][node], True), (t["right"][node], False)):
        ends = (low, min(high, cut)) if left else (max(low, cut), high)
        yield child, {**path, f: (*ends, z * (t["cover"][child] / t["cover"][node]))}, left


def _packed(leaves: list[tuple[dict, float]]) -> list[Paths]:
    """Paths and values of leaves, by the number of features; leaves without any are left out."""
    sizes: dict[int, list] = {}
    for path, value in leaves:
        sizes.setdefault(len(path), []).append((path, value))
    return [Paths(
        np.array([list(p) for p, _ in some]),
        *(np.array([[x[i] for x in p.values()] for p, _ in some]) for i in range(3)),
        np.array([v for _, v in some])) for size, some in sorted(sizes.items()) if size]


def _points(size: int) -> Iterator[tuple[float, float]]:
    """Points and weights that integrate polynomials of degree ``size`` - 1 over 0 to 1."""
    t, w = np.polynomial.legendre.leggauss(-(-size // 2))
    return zip((t + 1) / 2, w / 2)


def _inside(x: np.ndarray, p: Paths) -> np.ndarray:
    seen = x[:, p.feature]
    # NaN goes right, as in the trees
    return (~(seen <= p.low)) & ((seen <= p.high) | np.isposinf(p.high))


def _parts(x: np.ndarray, table: list[Paths], pairs: bool) -> Iterator[tuple[slice, Paths]]:
    """Slices of rows and leaves whose cells fit."""
    for p in table:
        size = p.feature.shape[1] ** (2 if pairs else 1)
        step = max(1, CELLS // size // max(1, len(p.value)))
        leaves = max(1, CELLS // size)
        for first in range(0, len(p.value), leaves):
            part = Paths(*(c[first:first + leaves] for c in p))
            for at in range(0, len(x), step):
                yield slice(at, at + step), part


def _shares(inside: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What leaves add to the features of their paths (rows x leaves x places)."""
    rest = np.zeros(inside.shape)
    for t, w in _points(inside.shape[2]):
        term = share * (1 - t) + inside * t
        rest += w * term.prod(axis=2, keepdims=True) / term
    return value[:, None] * (inside - share) * rest


def shap_values(x: np.ndarray, table: list[Paths]) -> np.ndarray:
    """Shapley values of rows of features (rows x features)."""
    out = np.zeros(x.shape)
    for rows, p in _parts(x, table, False):
        part = _shares(_inside(x[rows], p), p.share, p.value)
        _add(out[rows], p.feature.ravel(), part.reshape(len(part), -1))
    return out


class Group(NamedTuple):
    """Leaves below a node, and the comparisons that tell which of their intervals hold a row."""

    bits: list[tuple]       # feature, low, high
    paths: list[dict]       # low, high and share by feature, for each leaf
    asked: list[dict]       # bits and their answers by feature, for each leaf
    values: list[float]


def _below(t: dict, bits: int) -> list[set | None]:
    """Comparisons at and below each node; None where there are more than ``bits``."""
    found: list[set | None] = [set() for _ in t["left"]]
    order = [0]
    for node in order:
        if t["left"][node] >= 0:
            order += [t["left"][node], t["right"][node]]
    for node in reversed(order):
        if t["left"][node] >= 0:
            sides = found[t["left"][node]], found[t["right"][node]]
            own = None if None in sides else {(t["feature"][node], t["threshold"][node])}.union(*sides)
            found[node] = own if own and len(own) <= bits else None
    return found


def leaf_groups(t: dict, bits: int) -> tuple[list[Group], list[Paths]]:
    """Leaves of a tree in groups of at most ``bits`` comparisons, and those with longer paths."""
    groups, long, below = [], [], _below(t, bits)
    waiting: list[tuple] = [(0, {}, None, {})]
    while waiting:
        node, path, group, asked = waiting.pop()
        if group is None and below[node] is not None and len(path) + len(below[node]) <= bits:
            group = Group([*((f, low, high) for f, (low, high, _) in path.items()),
                           *((f, -np.inf, cut) for f, cut in sorted(below[node]))], [], [], [])
            asked = {f: [(i, True)] for i, f in enumerate(path)}
            groups.append(group)
        if t["left"][node] < 0:
            if group is None:
                long.append((path, t["value"][node]))
            else:
                for column, v in zip(group[1:], (path, asked, t["value"][node])):
                    column.append(v)
            continue
        f, cut = t["feature"][node], t["threshold"][node]
        for child, path_there, left in _children(t, node, path):
            answer = {} if group is None else {f: [*asked.get(f, ()), (
                len(group.bits) - 1 - group.bits[::-1].index((f, -np.inf, cut)), left)]}
            waiting.append((child, path_there, group, {**asked, **answer}))
    return groups, _packed(long)


def _group_table(group: Group, columns: dict[int, np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Features of a group, and what its leaves add to them for all answers (features x answers)."""
    features = sorted({f for path in group.paths for f in path})
    place = {f: i for i, f in enumerate(features)}
    answers = np.arange(1 << len(group.bits))
    bit = [(answers >> i & 1).astype(bool) for i in range(len(group.bits))]
    out = np.zeros((len(features), len(answers)))
    for path, asked, value in zip(*group[1:]):
        code = np.zeros(len(answers), np.int64)
        for j, f in enumerate(path):
            inside = np.ones(len(answers), bool)
            for i, yes in asked[f]:
                inside &= bit[i] if yes else ~bit[i]
            code |= inside.astype(np.int64) << j
        out[[place[f] for f in path]] += np.take(columns[id(path)], code, axis=1)
    return features, out


def _leaf_tables(groups: list[Group]) -> dict[int, np.ndarray]:
    """What each leaf adds, by path: places x all sets of intervals that hold a row."""
    by_size: dict[int, list] = {}
    for g in groups:
        for path, value in zip(g.paths, g.values):
            by_size.setdefault(len(path), []).append((path, value))
    out = {}
    for size, leaves in by_size.items():
        inside = (np.arange(1 << size)[:, None] >> np.arange(size) & 1).astype(bool)[:, None]
        step = max(1, CELLS // (size << size)) if size else len(leaves)
        for at in range(0, len(leaves), step):
            some = leaves[at:at + step]
            share = np.array([[z for _, _, z in path.values()] for path, _ in some])
            part = _shares(np.repeat(inside, len(some), axis=1), share, np.array([v for _, v in some])) \
                if size else np.zeros((1, len(some), 0))
            for (path, _), own in zip(some, np.ascontiguousarray(part.transpose(1, 2, 0))):
                out[id(path)] = own
    return out


def grouped_shap_values(x: np.ndarray, trees: list[dict], bits: int = BITS) -> np.ndarray:
    """The same as ``shap_values`` for many rows, by tables of groups of leaves."""
    rows = np.ascontiguousarray(x.T)
    out = np.zeros(rows.shape)
    for t in trees:
        groups, long = leaf_groups(t, bits)
        tables, held = _leaf_tables(groups), {}
        if long:
            out += shap_values(x, long).T

        def upto(f: int, cut: float) -> np.ndarray:
            if (f, cut) not in held:
                held[f, cut] = rows[f] <= cut          # never true for NaN, which goes right
            return held[f, cut]

        for g in groups:
            features, table = _group_table(g, tables)
            for at in range(0, len(x), CHUNK):
                part = slice(at, at + CHUNK)
                code = np.zeros(len(rows[0, part]), np.uint16)
                for i, (f, low, high) in enumerate(g.bits):
                    inside = np.ones(len(code), bool) if high == np.inf else upto(f, high)[part]
                    if low > -np.inf:
                        inside = inside & ~upto(f, low)[part]
                    code |= inside.astype(np.uint16) << np.uint16(i)
                code = code.astype(np.intp)
                for f, sums in zip(features, table):
                    out[f, part] += sums.take(code)
    return out.T


def interaction_values(x: np.ndarray, table: list[Paths]) -> np.ndarray:
    """Pair interactions (rows x features x features); each row of a matrix sums to the Shapley value."""
    width = x.shape[1]
    out = np.zeros((len(x), width * width))
    for rows, p in _parts(x, table, True):
        size = p.feature.shape[1]
        if size < 2:
            continue
        inside = _inside(x[rows], p)
        first, second = np.triu_indices(size, 1)
        rest = np.zeros((*inside.shape[:2], len(first)))
        for t, w in _points(size):
            term = p.share * (1 - t) + inside * t
            rest += w * term.prod(axis=2, keepdims=True) / (term[..., first] * term[..., second])
        lean = inside - p.share
        part = (0.5 * p.value[:, None] * lean[..., first] * lean[..., second] * rest).reshape(
            len(inside), -1)
        a, b = p.feature[:, first].ravel(), p.feature[:, second].ravel()
        _add(out[rows], a * width + b, part)
        _add(out[rows], b * width + a, part)
    out = out.reshape(len(x), width, width)
    own = np.arange(width)
    out[:, own, own] = shap_values(x, table) - out.sum(axis=2)
    return out


def _add(out: np.ndarray, column: np.ndarray, part: np.ndarray) -> None:
    """Adds columns of ``part`` that belong to the same column of ``out``."""
    order = np.argsort(column, kind="stable")
    columns, first = np.unique(column[order], return_index=True)
    out[:, columns] += np.add.reduceat(part[:, order], first, axis=1)


def _features(df: DataFrame, fitted, id_col: str) -> DataFrame:
    before = PipelineModel(fitted.pipeline.stages[:-1])
    return before.transform(df).select(q(id_col).alias("row_id"),
                                       vector_to_array("features").alias("x"))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together until they have ``ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= ROWS:
            yield held
            held = []
    if held:
        yield held


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


def tree_shap(df: DataFrame, fitted, id_col: str = ID) -> DataFrame:
    """Long table ``(row_id, feature, shap)`` over the model's features, with the mean as ``(base)``.

    The values of a row add up to its margin (boosted trees) or its probability (forests, trees).
    """
    trees = trees_of(fitted.classifier)
    base, table = path_table(trees)
    sent = df.sparkSession.sparkContext.broadcast((trees, table))
    rows, width = _features(df, fitted, id_col), len(fitted.feature_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            x = np.concatenate([_matrix(b, width) for b in held])
            found = grouped_shap_values(x, sent.value[0]) if len(x) >= FEW else shap_values(
                x, sent.value[1])
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), _lists(found[at:at + b.num_rows])], ["row_id", "shap"])
                at += b.num_rows

    kind = rows.schema["row_id"].dataType.simpleString()
    names = F.array(*[F.lit(n) for n in fitted.feature_names], F.lit("(base)"))
    wide = rows.mapInArrow(run, f"row_id {kind}, shap array<double>")
    return wide.select("row_id", F.posexplode(F.concat("shap", F.array(F.lit(base)))).alias("j", "shap")
                       ).select("row_id", F.get(names, F.col("j")).alias("feature"), "shap")


def tree_interactions(df: DataFrame, fitted, id_col: str = ID) -> DataFrame:
    """Long table ``(row_id, feature_1, feature_2, interaction)`` of all pairs, in the model's order.

    A pair is given once with its whole size, ``feature_1 = feature_2`` is the main effect, so a
    row's entries add up to its score less the mean.
    """
    _, table = path_table(trees_of(fitted.classifier))
    sent = df.sparkSession.sparkContext.broadcast(table)
    rows, width = _features(df, fitted, id_col), len(fitted.feature_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.triu_indices(width)
        whole = np.where(first == second, 1.0, 2.0)
        step = max(1, CELLS // (width * width))
        for b in batches:
            for at in range(0, b.num_rows, step):
                x = np.stack(b.column(1)[at:at + step].to_numpy(zero_copy_only=False))
                found = interaction_values(x, sent.value)[:, first, second] * whole
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:at + step], pa.array(list(found))], ["row_id", "found"])

    kind = rows.schema["row_id"].dataType.simpleString()
    names = fitted.feature_names
    pairs = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"))
                      for i, j in zip(*np.triu_indices(width))])
    wide = rows.mapInArrow(run, f"row_id {kind}, found array<double>")
    return wide.select("row_id", F.posexplode("found").alias("k", "interaction")).select(
        "row_id", F.get(pairs, F.col("k")).alias("pair"), "interaction").select(
        "row_id", F.col("pair.a").alias("feature_1"), F.col("pair.b").alias("feature_2"), "interaction")


def interaction_strength(df: DataFrame, fitted, n_rows: int = 100, id_col: str = ID) -> DataFrame:
    """Mean size of each pair's interaction over the first ``n_rows`` rows by id.

    The row limit belongs to the report; all features of the model take part.
    """
    rows = df.orderBy(q(id_col)).limit(n_rows)
    return tree_interactions(rows, fitted, id_col).where(F.col("feature_1") != F.col("feature_2")).groupBy(
        "feature_1", "feature_2").agg(F.avg(F.abs("interaction")).alias("interaction_strength"))
