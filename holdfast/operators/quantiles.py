"""Exact quantiles with linear interpolation.

One way for any number of rows: approximate quantiles bracket the wanted positions, the rows inside
the brackets are counted, and the brackets shrink until they hold few rows or one value. Where a
sketch brings no smaller bracket, the bracket is cut into cells of equal width, and the cell that
holds the position is kept, from its least to its greatest value; that always shrinks it. Only rows
of the last, small brackets are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bracket may hold when it is ordered.
BRACKET_ROWS = 1000
ACCURACY = 10_000
CELLS = 1024


def _interpolate(low: float, high: float, position: float) -> float:
    """Weighted mean of two neighbours; equal neighbours and whole positions stay exact."""
    first, last = math.floor(position), math.ceil(position)
    if first == last or low == high:
        return low
    return (last - position) * low + (position - first) * high


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: Sequence[float],
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several expressions, as fitted numbers."""
    names = list(values)
    probs = [float(p) for p in probs]
    slim = df.select(*[
        F.when(~F.isnan(values[n].cast("double")), values[n].cast("double")).alias(f"v{i}")
        for i, n in enumerate(names)
    ])
    counts = slim.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    total = {i: counts[f"n{i}"] for i in range(len(names))}
    found: dict[int, list[float | None]] = {i: [None] * len(probs) for i in total if not total[i]}
    filled = [i for i in total if total[i]]
    if filled:
        found.update(_bracketed(slim, filled, total, probs, bracket_rows))
    return {n: found[i] for i, n in enumerate(names)}


def quantile(df: DataFrame, col: str, p: float, bracket_rows: int = BRACKET_ROWS) -> float | None:
    return quantiles(df, {col: F.col(f"`{col}`")}, [p], bracket_rows)[col][0]


def _probes(first: int, last: int, below: int, size: int) -> tuple[float, float]:
    """Ranks on either side of a position, wide enough for the error of the sketch."""
    slack = 2.0 / ACCURACY
    return max((first - below) / size - slack, 0.0), min((last - below + 1) / size + slack, 1.0)


def _bracketed(slim, columns, total, probs, limit):
    targets = [(i, j) for i in columns for j in range(len(probs))]
    position = {(i, j): probs[j] * (total[i] - 1) for i, j in targets}
    first = {t: math.floor(position[t]) for t in targets}
    last = {t: math.ceil(position[t]) for t in targets}
    ends = slim.agg(*[
        e for i in columns
        for e in (F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"))
    ]).first()
    low = {(i, j): ends[f"lo{i}"] for i, j in targets}
    high = {(i, j): ends[f"hi{i}"] for i, j in targets}
    below = {t: 0 for t in targets}
    inside = {(i, j): total[i] for i, j in targets}
    known: dict[tuple, tuple] = {}
    open_targets = {t for t in targets if low[t] < high[t] and inside[t] > limit}
    while open_targets:
        work = sorted(open_targets)
        shared: dict[tuple, list] = {}       # targets of one column and bracket share a sketch
        for t in work:
            shared.setdefault((t[0], low[t], high[t]), []).append(t)
        exprs = []
        for n, ((i, lo, hi), ts) in enumerate(shared.items()):
            col = F.col(f"v{i}")
            points = [x for t in ts for x in _probes(first[t], last[t], below[t], inside[t])]
            held = F.when((col >= lo) & (col <= hi), col)
            exprs.append(F.percentile_approx(held, points, ACCURACY).alias(f"b{n}"))
        guess = slim.agg(*exprs).first()
        trial = {
            t: tuple(guess[f"b{n}"][2 * m: 2 * m + 2])
            for n, ts in enumerate(shared.values()) for m, t in enumerate(ts)
        }
        counted = slim.agg(*[
            e for n, t in enumerate(work)
            for e in (
                F.count_if(F.col(f"v{t[0]}") < trial[t][0]).alias(f"under{n}"),
                F.count_if(F.col(f"v{t[0]}").between(*trial[t])).alias(f"in{n}"),
            )
        ]).first()
        stuck = []
        for n, t in enumerate(work):
            lo, hi, under, held = *trial[t], counted[f"under{n}"], counted[f"in{n}"]
            if under <= first[t] and last[t] < under + held and held < inside[t]:
                low[t], high[t], below[t], inside[t] = lo, hi, under, held
            else:
                stuck.append(t)
        if stuck:
            known.update(_cut_to_cells(slim, stuck, low, high, below, inside, first, last))
        open_targets = {
            t for t in open_targets
            if t not in known and low[t] < high[t] and inside[t] > limit
        }
    rest = [t for t in targets if t not in known]
    picked = known | _order_statistics(slim, rest, low, high, below, first, last)
    return {
        i: [
            _interpolate(*picked[(i, j)], position[(i, j)])
            for j in range(len(probs))
        ]
        for i in columns
    }


def _cut_to_cells(slim, targets, low, high, below, inside, first, last):
    """Shrink each bracket to the cell of equal width that holds its two positions.

    Where two cells hold them, the values are found, and returned.
    """
    entries = []
    for n, t in enumerate(targets):
        v, lo, hi = F.col(f"v{t[0]}"), low[t], high[t]
        step = hi / CELLS - lo / CELLS          # no overflow where the range is huge
        cell = F.floor((v / 1.0 - lo) / step) if 0 < step < float("inf") else F.lit(0.0)
        # the ends keep cells of their own, so that the bracket shrinks whatever the rounding
        cell = F.when(v == lo, -1).when(v == hi, CELLS + 1).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(CELLS), cell.cast("int"))))
        entries.append(F.when(v.between(lo, hi), F.struct(
            F.lit(n).alias("t"), cell.cast("int").alias("cell"), v.alias("v"))))
    cells = (
        slim.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("t", "cell")
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("t", "lo").collect()
    )
    known = {}
    for n, t in enumerate(targets):
        under = below[t]
        kept = []
        for r in (r for r in cells if r["t"] == n):
            if under <= last[t] and first[t] < under + r["n"]:
                kept.append((under, r))
            under += r["n"]
        if len(kept) > 1:        # the positions are the end of one cell and the start of the next
            known[t] = kept[0][1]["hi"], kept[-1][1]["lo"]
            continue
        below[t], cell = kept[0]
        low[t], high[t], inside[t] = cell["lo"], cell["hi"], cell["n"]
    return known


def _order_statistics(slim, targets, low, high, below, first, last):
    """Values at two neighbouring positions of each bracket."""
    done = {t: (low[t], low[t]) for t in targets if low[t] == high[t]}
    rest = [t for t in targets if t not in done]
    if not rest:
        return done
    entries = [
        F.when(F.col(f"v{t[0]}").between(low[t], high[t]),
               F.struct(F.lit(n).alias("t"), F.col(f"v{t[0]}").alias("v")))
        for n, t in enumerate(rest)
    ]
    long = slim.select(F.inline(F.array_compact(F.array(*entries))))
    upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        long.groupBy("t", "v").agg(F.count("*").alias("n"))
        .withColumn("end", F.sum("n").over(upto))
        .withColumn("start", F.col("end") - F.col("n"))
    )

    def at(which):
        wanted = F.create_map(*[
            x for n, t in enumerate(rest) for x in (F.lit(n), F.lit(which[t] - below[t]))
        ])
        spot = wanted[F.col("t")]
        return F.min(F.when((F.col("start") <= spot) & (spot < F.col("end")), F.col("v")))

    rows = ranked.groupBy("t").agg(at(first).alias("a"), at(last).alias("b")).collect()
    done.update({rest[r["t"]]: (r["a"], r["b"]) for r in rows})
    return done
