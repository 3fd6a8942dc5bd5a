"""Splits, samples and folds by hashed row id.

A split never depends on the order or the partitioning of rows. Exact sizes need the position of a
row in hash order, but only one hash value per class decides a cut: counts per hash bucket find the
bucket that holds it, and only that bucket is ordered. Rows are then compared with that value, in
place, without a shuffle of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.ordering import hash_bucket, hash_key, hash_rank
from holdfast.operators.profile import q
from holdfast.schema import ID


def _class_sizes(df: DataFrame, target: str | None) -> dict:
    if target is None:
        return {None: df.count()}
    rows = df.groupBy(q(target).alias("k")).agg(F.count("*").alias("n")).collect()
    return {r["k"]: r["n"] for r in rows}


def _cuts(df: DataFrame, id_col: str, seed: int, target: str | None, quota: dict) -> dict:
    """Per class the (hash, id) of the last row inside its quota."""
    group = q(target) if target else F.lit(None).cast("string")
    keyed = df.select(
        group.alias("_class"), q(id_col).alias("_id"), hash_key(id_col, seed).alias("_key")
    ).withColumn("_bucket", hash_bucket())
    wanted = F.coalesce(*[
        F.when(F.col("_class").eqNullSafe(F.lit(k)), F.lit(n)) for k, n in quota.items()
    ])
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("n"))
        .withColumn("end", F.sum("n").over(upto))
        .withColumn("need", wanted - (F.col("end") - F.col("n")))
        .filter((F.col("need") > 0) & (F.col("need") <= F.col("n")))
        .select(F.col("_class").alias("c"), F.col("_bucket").alias("b"), "need")
        .collect()                       # one row per class
    )
    if not edge:
        return {}
    here = [
        F.col("_class").eqNullSafe(F.lit(r["c"])) & (F.col("_bucket") == r["b"]) for r in edge
    ]
    need = F.coalesce(*[F.when(cond, F.lit(r["need"])) for cond, r in zip(here, edge)])
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_key", "_id"))
    found = (
        keyed.withColumn("need", need).filter(F.col("need").isNotNull())
        .withColumn("rank", rank).filter(F.col("rank") == F.col("need"))
        .select("_class", "_key", "_id").collect()
    )
    return {r["_class"]: (r["_key"], r["_id"]) for r in found}


def _inside(
    df: DataFrame, id_col: str, seed: int, target: str | None,
    quota_of: Callable[[dict], dict],
) -> Column:
    """Condition that is true for the first ``quota`` rows of each class in hash order."""
    sizes = _class_sizes(df, target)
    quota = {k: min(n, sizes[k]) for k, n in quota_of(sizes).items() if n > 0}
    if not quota:
        return F.lit(False)
    cuts = _cuts(df, id_col, seed, target, quota)
    key, rid = hash_key(id_col, seed), q(id_col)
    hits = []
    for k, (cut_key, cut_id) in cuts.items():
        first = (key < cut_key) | ((key == cut_key) & (rid <= F.lit(cut_id)))
        hits.append(first if target is None else q(target).eqNullSafe(F.lit(k)) & first)
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def half_up(x: float) -> int:
    """Round to the nearest integer; tolerate the noise of ``fraction * count``."""
    return math.floor(x + 0.5 + 1e-9)


def stratified_split(
    df: DataFrame, target: str, frac: float = 0.8, seed: int = 42, id_col: str = ID,
    out: str = "is_train",
) -> DataFrame:
    """Flag an exact share of every class."""
    inside = _inside(
        df, id_col, seed, target, lambda sizes: {k: half_up(frac * n) for k, n in sizes.items()}
    )
    return df.withColumn(out, inside)


def random_split(df: DataFrame, frac: float = 0.8, seed: int = 42, id_col: str = ID,
                 out: str = "is_train") -> DataFrame:
    """Flag an exact share of all rows."""
    inside = _inside(df, id_col, seed, None, lambda s: {None: half_up(frac * s[None])})
    return df.withColumn(out, inside)


def shuffle_split(df: DataFrame, frac: float = 0.8, seed: int = 42, id_col: str = ID,
                  out: str = "is_train") -> DataFrame:
    """Flag the first ``floor(frac * n)`` rows in hash order."""
    inside = _inside(df, id_col, seed, None, lambda s: {None: math.floor(frac * s[None] + 1e-9)})
    return df.withColumn(out, inside)


def hash_split(df: DataFrame, frac: float = 0.8, seed: int = 42, id_col: str = ID,
               out: str = "is_train") -> DataFrame:
    """Approximate share by hash value alone: one projection, also on streams."""
    part = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, part < F.lit(int(frac * 2**32)))


def class_quotas(sizes: dict, n: int) -> dict:
    """Split ``n`` over the classes in proportion; largest remainders get the rest."""
    total = sum(sizes.values())
    n = min(n, total)
    if total == 0:
        return {}
    base = {k: n * c // total for k, c in sizes.items()}
    order = sorted(sizes, key=lambda k: (-(n * sizes[k] % total), str(k)))
    for k in order[: n - sum(base.values())]:
        base[k] += 1
    return base


def stratified_sample(df: DataFrame, target: str, n: int = 50_000, seed: int = 42,
                      id_col: str = ID) -> DataFrame:
    """Exactly ``min(n, rows)`` rows with the class shares of the table."""
    return df.filter(_inside(df, id_col, seed, target, lambda sizes: class_quotas(sizes, n)))


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = ID) -> DataFrame:
    """The ``n`` rows with the lowest hash."""
    return df.orderBy(hash_key(id_col, seed), q(id_col)).limit(n)


def add_folds(df: DataFrame, target: str, k: int = 5, seed: int = 42, id_col: str = ID,
              out: str = "fold") -> DataFrame:
    """Fold number 0..k-1; every fold holds an equal share of every class."""
    ranked = hash_rank(df, id_col, seed, within=[target], out="_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def shuffle_labels(df: DataFrame, target: str, seed: int = 42, id_col: str = ID,
                   out: str = "shuffled") -> DataFrame:
    """Give every row the label of another row: positions in two hash orders are matched."""
    left = hash_rank(df, id_col, seed, out="_pos")
    right = hash_rank(df.select(q(id_col), q(target).alias(out)), id_col, seed + 1, out="_pos")
    return left.join(right.drop(id_col), "_pos").drop("_pos")
