"""Global ranks and running sums without a single-task window.

Rows are first put into buckets whose order is the global order. A window then runs inside each
bucket, and every bucket adds the total of the buckets before it. Only the per-bucket totals, of
which there are few, are ordered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 4          # 16 ** 4 buckets of equal size
SCORE_BUCKETS = 256      # at least; with more rows, the root of their number
MOST_BUCKETS = 4096      # splits are collected and sent with the plan, so their number is bounded
FINE = 64                # parts of a bucket where the bound is reached


def hash_key(id_col: str, seed: int) -> Column:
    """Order key that depends on the seed and the row id only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")))


def hash_bucket(key: str = "_key") -> Column:
    return F.substring(F.col(key), 1, HASH_DIGITS)


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    bucket: str,
    order: Sequence[Column],
    within: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over all rows up to and including this one.

    ``bucket`` must rise (or fall, with ``descending``) with the order.
    """
    # Keys without nulls: a plain equality keeps the window's partitioning for the join.
    keys = {
        f"_k{i}": F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
        for i, c in enumerate([*within, bucket])
    }
    values = {f"_v_{n}": c for n, c in sums.items()}
    df = df.withColumns({**keys, **values})
    *classes, _ = keys
    first = F.col("_at").desc() if descending else F.col("_at").asc()
    earlier = Window.partitionBy(*classes).orderBy(first).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        df.groupBy(*keys)
        .agg(F.min(bucket).alias("_at"), *[F.sum(v).alias(f"_t{v}") for v in values])
        .select(*keys, *[
            F.coalesce(F.sum(f"_t{v}").over(earlier), F.lit(0)).alias(f"_o{v}") for v in values
        ])
    )
    inside = (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = df.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    out = ranked.join(offsets, list(keys), "inner").withColumns({
        n: F.col(f"_r_{n}") + F.col(f"_o_v_{n}") for n in sums
    })
    return out.drop(*keys, *values, *[f"_r_{n}" for n in sums], *[f"_o_v_{n}" for n in sums])


def hash_rank(
    df: DataFrame, id_col: str, seed: int, within: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """1-based position of each row in the order of its hash key, per class."""
    keyed = df.withColumn("_key", hash_key(id_col, seed)).withColumn("_bucket", hash_bucket())
    return running_sums(
        keyed, {out: F.lit(1)}, "_bucket", [F.col("_key"), F.col(f"`{id_col}`")], within
    ).drop("_key", "_bucket")


def score_splits(df: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of ``col``; fitted once so that buckets never change.

    There are at most ``MOST_BUCKETS``; ``with_score_bucket`` cuts each again where that bound holds.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(SCORE_BUCKETS, math.isqrt(df.count())))
    probs = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(col, probs, max(10_000, 4 * buckets))).first()[0] or []
    return sorted({float(x) for x in found})


def with_score_bucket(df: DataFrame, col: str, splits: Sequence[float], out: str = "_bucket"):
    """Bucket number rising with ``col``, by binary search over the splits.

    With as many splits as there may be, each bucket between two of them is cut into ``FINE`` parts of
    equal width, found from the value alone. Parts rise with the value, so sums over buckets hold
    whatever their sizes are.
    """
    if not splits:
        return df.withColumn(out, F.lit(0.0))
    edges = [-float("inf"), *splits, float("inf")]
    found = Bucketizer(splits=edges, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
    if len(splits) < MOST_BUCKETS // 2:
        return found
    at = F.lit([float(x) for x in splits])
    low, high = F.get(at, F.col(out).cast("int") - 1), F.get(at, F.col(out).cast("int"))
    part = F.least(F.floor((F.col(col) - low) / (high - low) * FINE), F.lit(FINE - 1)) / FINE
    return found.withColumn(out, F.col(out) + F.coalesce(part, F.lit(0.0)))
