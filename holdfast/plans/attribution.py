"""Attributions of any probability model, as Spark jobs.

``shap_sampled`` follows the sampled-permutation estimate of Shapley values (Strumbelj and
Kononenko 2014). A row and a permutation give one mixed record per prefix: features of the prefix
come from the row, all others from a background row. The model scores all mixed records in one
transform, and every score counts once for the feature just added and once against the next one,
so sums are combined before they are shuffled.

``kernel_shap`` fits an additive model to the scores of coalitions, with the weights that make its solution
the Shapley values (Lundberg and Lee 2017). The coalitions are the same for all rows, so the constrained
least squares are solved once and a row's values are weighted sums of its coalitions' scores.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.profile import q
from holdfast.operators.split import sample_n
from holdfast.schema import ID

BACKGROUND_ROWS = 100

Scorer = Callable[[DataFrame], DataFrame]     # adds a column ``p``


def _background(df: DataFrame, cols: Sequence[str], id_col: str, n: int, seed: int):
    """A hundred rows at most; small enough to be literals."""
    rows = sample_n(df.select(q(id_col), *[q(c) for c in cols]), n, seed, id_col).collect()
    return [tuple(r[c] for c in cols) for r in rows]


def _background_column(rows, df: DataFrame, cols: Sequence[str], pick):
    """The chosen background row as a struct."""
    types = {c: df.schema[c].dataType for c in cols}
    table = F.array(*[
        F.struct(*[F.lit(v).cast(types[c]).alias(f"b{i}")
                   for i, (c, v) in enumerate(zip(cols, row))])
        for row in rows
    ])
    return F.get(table, pick)


def _pick(id_col: str, salt, n: int):
    return F.pmod(F.xxhash64(q(id_col), salt), F.lit(n)).cast("int")


def shap_sampled(df: DataFrame, score: Scorer, background: DataFrame, cols: Sequence[str],
                 n_perm: int = 10, id_col: str = ID, seed: int = 42) -> DataFrame:
    """Long table ``(row_id, feature, shap)``; sums over features equal p(x) minus the mean
    score of the background rows that were drawn for x, which is returned as ``base``.
    """
    cols = list(cols)
    rng = random.Random(seed)
    perms = [rng.sample(range(len(cols)), len(cols)) for _ in range(n_perm)]
    rows = _background(background, cols, id_col, BACKGROUND_ROWS, seed)
    # positions[m][j] is the place of feature j in permutation m
    places = F.array(*[
        F.array(*[F.lit(perm.index(j)) for j in range(len(cols))]) for perm in perms
    ])
    orders = F.array(*[F.array(*[F.lit(j) for j in perm]) for perm in perms])
    base = df.select(q(id_col).alias("_id"), *[q(c) for c in cols])
    exploded = (
        base.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
        .withColumn("_b", _background_column(rows, df, cols, _pick("_id", F.col("_m"), len(rows))))
        .withColumn("_place", F.get(places, F.col("_m")))
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))))
    )
    mixed = exploded.select(
        "_id", "_m", "_s",
        *[
            F.when(F.get("_place", F.lit(i)) < F.col("_s"), q(c)).otherwise(F.col(f"_b.b{i}"))
            .alias(c)
            for i, c in enumerate(cols)
        ],
    )
    scored = score(mixed).select("_id", "_m", "_s", "p")
    order = F.get(orders, F.col("_m"))
    added = F.when(F.col("_s") > 0, F.struct(
        F.get(order, F.col("_s") - 1).alias("j"), F.col("p").alias("v")
    ))
    following = F.when(F.col("_s") < len(cols), F.struct(
        F.get(order, F.col("_s")).alias("j"), (-F.col("p")).alias("v")
    ))
    start = F.when(F.col("_s") == 0, F.struct(F.lit(-1).alias("j"), F.col("p").alias("v")))
    parts = scored.select("_id", F.inline(F.array_compact(F.array(added, following, start))))
    names = F.array(*[F.lit(c) for c in cols])
    return parts.groupBy(F.col("_id").alias("row_id"), "j").agg(
        (F.sum("v") / n_perm).alias("shap")
    ).select(
        "row_id",
        F.when(F.col("j") >= 0, F.get(names, F.greatest("j", F.lit(0)))).otherwise("(base)")
        .alias("feature"), "shap",
    )


def coalitions(width: int, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Sets of features as rows of 0 and 1, and their weights; all proper sets if there are at most ``n``.

    Beyond that whole sizes are taken from both ends, smallest and largest sets first, as long as
    they fit. The rest is drawn in pairs of a set and its complement, and shares what weight is left.
    """
    def weight(size):     # of all sets of this size together
        return (width - 1) / (size * (width - size))

    sets: dict[tuple, float] = {}
    sizes = list(range(1, width))
    while sizes:
        ends = {sizes[0], sizes[-1]}
        if len(sets) + sum(math.comb(width, k) for k in ends) > n:
            break
        for k in ends:
            for s in itertools.combinations(range(width), k):
                sets[s] = weight(k) / math.comb(width, k)
            sizes.remove(k)
    room = (n - len(sets)) // 2
    if sizes and room > 0:
        rng = random.Random(seed)
        drawn: dict[tuple, int] = {}
        for _ in range(room):
            k = rng.choices(sizes, [weight(k) for k in sizes])[0]
            s = tuple(sorted(rng.sample(range(width), k)))
            for t in (s, tuple(j for j in range(width) if j not in s)):
                drawn[t] = drawn.get(t, 0) + 1
        share = sum(weight(k) for k in sizes) / sum(drawn.values())
        sets.update({s: share * times for s, times in drawn.items()})
    z = np.zeros((len(sets), width))
    for i, s in enumerate(sets):
        z[i, list(s)] = 1
    return z, np.array(list(sets.values()))


def kernel_weights(z: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of coalition scores, and of the full score, in each feature's value.

    Values are the least-squares fit to the scores less the empty one, and add up to the full score
    less the empty one.
    """
    width = z.shape[1]
    if width == 1:
        return np.zeros((1, len(z))), np.ones(1)
    solve = np.linalg.pinv(z.T @ (weight[:, None] * z))
    onto, ones = solve @ (z.T * weight), solve.sum(axis=1)
    return onto - np.outer(ones, onto.sum(axis=0)) / ones.sum(), ones / ones.sum()


def kernel_shap(df: DataFrame, score: Scorer, background: DataFrame, cols: Sequence[str],
                n: int = 2048, id_col: str = ID, seed: int = 42) -> DataFrame:
    """Long table ``(row_id, feature, shap)`` of any model, and ``(base)``, the background's mean score.

    Exact against the background when ``n`` coalitions are all there are. Every row meets every
    coalition and background row (at most ``BACKGROUND_ROWS``), so choose the rows first; scores are averaged
    before they are shuffled. Values add up to the row's score.
    """
    cols = list(cols)
    width = len(cols)
    rows = _background(background, cols, id_col, BACKGROUND_ROWS, seed)
    z, weight = coalitions(width, n, seed)
    part, full = kernel_weights(z, weight)
    held = np.vstack([np.zeros((1, width)), np.ones((1, width)), z]).astype(bool)
    # weight of each coalition's score in each value; the empty score is taken off all others
    factors = np.vstack([-(part.sum(axis=1) + full)[None], full[None], part.T])
    sets = F.array(*[F.array(*[F.lit(bool(b)) for b in s]) for s in held])
    mixed = df.select(q(id_col).alias("_id"), *[q(c) for c in cols]).withColumns({
        "_k": F.explode(F.sequence(F.lit(0), F.lit(len(held) - 1))),
    }).withColumn("_on", F.get(sets, F.col("_k"))).withColumn(
        "_m", F.explode(F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.lit(len(rows) - 1))))).withColumn(
        "_b", _background_column(rows, df, cols, F.col("_m")))
    mixed = mixed.select("_id", "_k", *[
        F.when(F.get("_on", F.lit(i)), q(c)).otherwise(F.col(f"_b.b{i}")).alias(c)
        for i, c in enumerate(cols)])
    means = score(mixed).groupBy("_id", "_k").agg(F.avg("p").alias("y"))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in factors])
    values = [F.sum(F.get(F.get(table, F.col("_k")), F.lit(i)) * F.col("y")) for i in range(width)]
    base = F.sum(F.when(F.col("_k") == 0, F.col("y")))
    names = F.array(*[F.lit(c) for c in cols], F.lit("(base)"))
    return means.groupBy(F.col("_id").alias("row_id")).agg(F.array(*values, base).alias("shap")).select(
        "row_id", F.posexplode("shap").alias("j", "shap")).select(
        "row_id", F.get(names, F.col("j")).alias("feature"), "shap")


def interactions(df: DataFrame, score: Scorer, background: DataFrame, cols: Sequence[str],
                 n_rows: int = 100, id_col: str = ID, seed: int = 42) -> DataFrame:
    """Mean size of the second difference per feature pair over at most ``n_rows`` rows.

    The row limit belongs to the report. Pairs are those of a fixed feature list.
    """
    cols = list(cols)
    rows = _background(background, cols, id_col, BACKGROUND_ROWS, seed)
    sample = df.orderBy(q(id_col)).limit(n_rows).select(
        q(id_col).alias("_id"), *[q(c) for c in cols]
    ).withColumn("_b", _background_column(rows, df, cols, _pick("_id", F.lit(seed), len(rows))))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    kinds = [(), *[(i,) for i in range(len(cols))], *pairs]
    held = F.array(*[F.array(*[F.lit(x) for x in k]).cast("array<int>") for k in kinds])
    mixed = sample.select("_id", "_b", *[q(c) for c in cols], F.posexplode(held).alias("_k", "_on"))
    mixed = mixed.select(
        "_id", "_k",
        *[
            F.when(F.array_contains("_on", i), q(c)).otherwise(F.col(f"_b.b{i}")).alias(c)
            for i, c in enumerate(cols)
        ],
    )
    scored = score(mixed).groupBy("_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "p"))).alias("f")
    )                                            # one entry per kind, a fixed number
    slot = {k: n for n, k in enumerate(kinds)}
    entries = [
        F.struct(
            F.lit(cols[i]).alias("feature_1"), F.lit(cols[j]).alias("feature_2"),
            F.abs(F.col("f")[slot[(i, j)]] - F.col("f")[slot[(i,)]] - F.col("f")[slot[(j,)]]
                  + F.col("f")[slot[()]]).alias("d"),
        )
        for i, j in pairs
    ]
    return scored.select(F.inline(F.array(*entries))).groupBy("feature_1", "feature_2").agg(
        F.avg("d").alias("interaction_strength")
    )
