"""Mergeable percentile states of endpoint metrics, the same in batch and stream.

Values are counted in cells whose bounds grow by a fixed factor, so every value of a cell is within the
relative ``error`` of the cell's middle. Counts of equal cells add up: the state of a long period is the sum of
the states of its short ones, in any order, and a percentile read from it is within ``error`` of the exact
nearest-rank percentile. Ranks are exact up to the cell. A state has at most some ``1420 / error`` cells, however
many requests there were; latencies fill a few hundred.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.streaming.windows import WATERMARK

#: Largest relative error of a percentile.
ERROR = 0.005
#: Cell numbers of positive values start here, those of negative ones mirror them, zero is cell 0.
_ZERO = 10_000_000


def factor(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def cell_of(value: Column, error: float = ERROR) -> Column:
    """Number of a value's cell; numbers are ordered as values are. Null for null and NaN."""
    place = F.ceil(F.ln(F.abs(value)) / F.lit(math.log(factor(error)))) + _ZERO
    signed = F.when(value > 0, place).when(value < 0, -place).when(value == 0, F.lit(0))
    return F.when(~F.isnan(value), signed).cast("long")


def middle_of(cell: Column, error: float = ERROR) -> Column:
    """The value that stands for a cell."""
    grow = factor(error)
    size = F.pow(F.lit(grow), F.abs(cell) - _ZERO) * F.lit(2 / (grow + 1))
    return F.when(cell > 0, size).when(cell < 0, -size).when(cell == 0, F.lit(0.0))


def percentile_cells(df: DataFrame, period_s: int = 60, error: float = ERROR,
                     watermark: str = WATERMARK) -> DataFrame:
    """Counts per endpoint, metric, period and cell, of batch and streaming metrics.

    Columns: endpoint, metric, start, end, cell, n. Values that are no numbers are left out.
    """
    cell = cell_of(F.col("value").cast("double"), error)
    return df.withColumn("cell", cell).where("cell IS NOT NULL").withWatermark("ts", watermark).groupBy(
        F.window("ts", f"{period_s} seconds"), "endpoint", "metric", "cell").agg(
        F.count("*").alias("n")).select(
        "endpoint", "metric", F.col("window.start").alias("start"), F.col("window.end").alias("end"),
        "cell", "n")


def merged_cells(cells: DataFrame, period_s: int) -> DataFrame:
    """Cells of longer periods from those of shorter ones that divide them."""
    return cells.groupBy(F.window("start", f"{period_s} seconds").alias("w"), "endpoint", "metric", "cell"
                         ).agg(F.sum("n").alias("n")).select(
        "endpoint", "metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cell", "n")


def states(cells: DataFrame) -> DataFrame:
    """One row per endpoint, metric and period, with ``state``: its cells and counts in order."""
    return cells.groupBy("endpoint", "metric", "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("state"))


def read_states(rows: DataFrame, probs: Sequence[float] = (0.5, 0.9, 0.99), error: float = ERROR
                ) -> DataFrame:
    """Replaces ``state`` by its number of values and nearest-rank percentiles."""
    total = F.aggregate("state", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    out = rows.withColumn("n", total)
    for p in probs:
        out = out.withColumn(f"p{round(p * 100)}", middle_of(_cell_at(
            F.greatest(F.ceil(F.col("n") * F.lit(float(p))), F.lit(1))), error))
    return out.drop("state")


def _cell_at(rank: Column) -> Column:
    """The cell of the value with a rank, from 1 on."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("cell"))

    def step(seen: Column, cell: Column) -> Column:
        return F.struct((seen["n"] + cell["n"]).alias("n"), F.when(
            seen["n"] < rank, cell["cell"]).otherwise(seen["cell"]).alias("cell"))

    return F.aggregate("state", start, step)["cell"]
