"""Operator 1. Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number). Boundaries between shards are found by counting:
every round counts the exact bytes below a set of candidate keys in all partitions, and the next
round puts its candidates only between the two that enclose a target. When every boundary is near
enough, the rows are exchanged once, by range.

Copies of a text are neighbours in this order. A boundary is moved to the edge of a group of
copies when the group is small; only groups above ``group_tolerance`` of a shard are split, between
two doc_ids, or between equal rows by their number. So one text, or one row, that holds a third of the
table still gives equal shards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from holdfast.llm.common import staged, table, text_of

SHARDS = 24
#: Least number of ranges per shard: the tasks of the exchange.
PIECES = 16
#: Bytes that one range holds at most, about; large shards have more ranges.
PIECE_BYTES = 16 << 30
#: Candidate keys per open boundary and round.
PROBES = 15
#: Allowed error of a boundary, as a part of a shard's bytes.
TOLERANCE = 0.001
#: Groups of copies up to this part of a shard are not split.
GROUP_TOLERANCE = 0.01
MAX_ROUNDS = 64

_LOW = -(2**63)
Key = tuple[int, int, int]


def positions(*keys_and_at) -> np.ndarray:
    """Number of sorted keys below each candidate; one array for each part of the key, then candidates."""
    *keys, at = keys_and_at
    first = np.array([p[0] for p in at], np.int64)
    lo, hi = np.searchsorted(keys[0], first, "left"), np.searchsorted(keys[0], first, "right")
    if len(keys) > 1:
        for i in np.flatnonzero(hi > lo):
            lo[i] += positions(*(k[lo[i]:hi[i]] for k in keys[1:]), [at[i][1:]])[0]
    return lo


def at_or_below(cuts: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Number of sorted cuts that are not above each row, both given by the parts of their keys."""
    lo, hi = np.searchsorted(cuts[0], rows[0], "left"), np.searchsorted(cuts[0], rows[0], "right")
    if len(cuts) == 1:
        return hi
    out = lo.copy()
    for v in np.unique(lo[hi > lo]):
        at = np.flatnonzero((lo == v) & (hi > lo))
        out[at] += at_or_below([c[v:hi[at[0]]] for c in cuts[1:]], [r[at] for r in rows[1:]])
    return out


def histogram(keys: DataFrame, at: list[Key]) -> list:
    """Per interval between candidates: bytes, rows, least and greatest key. At most one row each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            *key, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.lexsort(key[::-1])
            key, size = [k[order] for k in key], size[order]
            below = positions(*key, at) if at else []
            cut = np.concatenate([[0], below, [len(size)]]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            part = np.flatnonzero(cut[1:] > cut[:-1])
            a, z = cut[part], cut[part + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (part, total[z] - total[a], z - a, *(k[a] for k in key),
                                       *(k[z - 1] for k in key))],
                ["part", "size", "n", "a1", "a2", "a3", "z1", "z2", "z3"])

    found = keys.select("k1", "k2", "k3", "size").mapInArrow(
        count, "part long, size long, n long, a1 long, a2 long, a3 long, z1 long, z2 long, z3 long")
    return found.groupBy("part").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"),
        F.min(F.struct("a1", "a2", "a3")).alias("least"),
        F.max(F.struct("z1", "z2", "z3")).alias("most"),
    ).orderBy("part").collect()


class Bracket:
    """Where one boundary lies: between two keys, with the bytes below each."""

    def __init__(self, target: float, least: Key, most: Key, total: int):
        self.target, self.least, self.most, self.below, self.inside = target, least, most, 0, total
        self.found: Key | None = None

    def candidates(self, n: int, edges: list[tuple[int, int]]) -> list[Key]:
        """Keys spread evenly over the bracket; ``edges`` are the ranges of the second and third key."""
        (a2, z2), (a3, z3) = edges
        w2, w3 = z2 - a2 + 2, z3 - a3 + 2
        flat = [((k[0] - _LOW) * w2 + k[1] - a2) * w3 + k[2] - a3 for k in (self.least, self.most)]
        span = flat[1] + 1 - flat[0]
        spots = {flat[0] + span * i // (n + 1) for i in range(1, n + 1)} | {flat[1] + 1}
        return [(s // w3 // w2 + _LOW, s // w3 % w2 + a2, s % w3 + a3) for s in spots if s > flat[0]]

    def narrow(self, cells: list, ends: list[int], tol: float, group: float):
        """Use a round's counts: settle, or keep the cell that holds the target.

        ``cells`` are in the order of their keys, ``ends`` the bytes up to and with each. No cell
        crosses the edge of a bracket.
        """
        i = bisect_left(ends, self.target)
        while i < len(cells) and tuple(cells[i]["least"]) < self.least:
            i += 1                      # the target is the end of the cell before the bracket
        if i < len(cells) and tuple(cells[i]["most"]) <= self.most:
            self.below, self.inside = ends[i] - cells[i]["size"], cells[i]["size"]
            self.least, self.most = tuple(cells[i]["least"]), tuple(cells[i]["most"])
        end = self.below + self.inside
        low, high = self.target - self.below, end - self.target
        after = (*self.most[:2], self.most[2] + 1)
        whole = self.least[0] == self.most[0] and self.inside <= group
        if min(low, high) <= tol or self.least == self.most or whole:
            self.found = self.least if low <= high else after


def splitters(keys: DataFrame, parts: int, shards: int, tolerance: float = TOLERANCE,
              group_tolerance: float = GROUP_TOLERANCE) -> list[Key]:
    """Keys that cut the table into ``parts`` ranges of nearly equal bytes; a key starts its range.

    ``keys`` has long columns k1, k2, k3 without nulls and ``size``. Only histograms of at most
    ``parts * (PROBES + 1)`` rows reach the driver.
    """
    whole = histogram(keys, [])
    if not whole:
        return []
    total, least, most = whole[0]["size"], tuple(whole[0]["least"]), tuple(whole[0]["most"])
    a2, z2, a3, z3 = keys.agg(F.min("k2"), F.max("k2"), F.min("k3"), F.max("k3")).first()
    shard = total / shards
    open_ = [Bracket(total * j / parts, least, most, total) for j in range(1, parts)]
    every = list(open_)
    for _ in range(MAX_ROUNDS):
        if not open_:
            break
        at = sorted({c for b in open_ for c in b.candidates(PROBES, [(a2, z2), (a3, z3)])}
                    | {k for b in open_ for k in (b.least,)})
        cells = histogram(keys, at)
        ends = list(accumulate(r["size"] for r in cells))
        for b in open_:
            b.narrow(cells, ends, tolerance * shard, group_tolerance * shard)
        open_ = [b for b in open_ if b.found is None]
    if open_:
        raise RuntimeError(f"{len(open_)} boundaries open after {MAX_ROUNDS} rounds")
    cuts = [b.found for b in every]
    return [max(cuts[:i + 1]) for i in range(len(cuts))]


def pieces_of(keys: DataFrame, shards: int) -> int:
    """Ranges per shard, so that none is much above ``PIECE_BYTES``."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    return max(PIECES, -(-total // (shards * PIECE_BYTES)))


def range_of(cuts: list[Key], firsts: list[int] | None = None):
    """Function of Arrow batches that appends the range of a key: the splitters at or below it.

    With ``firsts``, one number per range, that of the row's range is appended as well.
    """
    more = None if firsts is None else np.array(firsts, np.int64)
    own = [np.array([c[i] for c in cuts], np.int64) for i in range(3)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = at_or_below(own, [b.column(n).to_numpy(zero_copy_only=False)
                                    for n in ("k1", "k2", "k3")])
            new = {"range": pa.array(out.astype(np.int32))}
            if more is not None:
                new["first"] = pa.array(more[out])
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], [*b.schema.names, *new])

    return place


def _with_range(df: DataFrame, *more: StructField) -> StructType:
    return StructType([*df.schema.fields, StructField("range", IntegerType()), *more])


def shard_rows(df: DataFrame, shards: int = SHARDS, pieces: int | None = None,
               tolerance: float = TOLERANCE) -> DataFrame:
    """Append ``shard`` and ``slot`` to rows with key columns ``k1``, ``k2``, ``k3`` and bytes ``size``.

    Null keys order first, null sizes count as nothing; ``k3`` may be absent. Rows that agree in all keys
    stay in one range, so number repeated rows in ``k3``. Columns of the frame named ``range``,
    ``first``, ``shard`` or ``slot`` are replaced. ``df`` is read several times, so give a written
    table. ``pieces`` ranges make a shard; by default as many as its bytes ask for. An empty table
    gives no rows.
    """
    df = df.drop("range", "first", "shard", "slot").withColumns({
        "k3": F.coalesce("k3", F.lit(0)).cast("long") if "k3" in df.columns else F.lit(0).cast("long"),
        "k1": F.coalesce("k1", F.lit(_LOW)), "k2": F.coalesce("k2", F.lit(_LOW + 1)),
        "size": F.coalesce("size", F.lit(0)),
    })
    pieces = pieces or pieces_of(df, shards)
    cuts = splitters(df, shards * pieces, shards, tolerance)
    counts = {r["part"]: r["n"] for r in histogram(df, cuts)}
    offsets, run = [], 0
    for i in range(shards * pieces):
        run = 0 if i % pieces == 0 else run
        offsets.append(run)
        run += counts.get(i, 0)
    ranged = df.mapInArrow(range_of(cuts, offsets), _with_range(df, StructField("first", LongType())))
    order = Window.partitionBy("range").orderBy("k1", "k2", "k3")
    return ranged.withColumns({
        "shard": (F.col("range") / pieces).cast("int"),
        "slot": F.col("first") + F.row_number().over(order) - 1,
    }).drop("range", "first")


def write_shards(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                 shards: int = SHARDS) -> None:
    """Write whole documents, one folder per shard, each file sorted by the sort key.

    A range is one task of the exchange and one file; its number is the number of the task, so no
    task has two ranges and none is idle.
    """
    keyed = docs.withColumns(_keys(text, key))
    narrow = staged(keyed.select("k1", "k2", "k3", "size"), "shard-keys")
    pieces = pieces_of(narrow, shards)
    cuts = splitters(narrow, shards * pieces, shards)
    ranged = keyed.mapInArrow(range_of(cuts), _with_range(keyed))
    (ranged.withColumn("shard", (F.col("range") / pieces).cast("int"))
     .repartitionById(shards * pieces, "range").sortWithinPartitions("range", "k1", "k2", "k3")
     .drop("k1", "k2", "k3", "size", "range").write.partitionBy("shard").parquet(path))


def _keys(text: str, key: str) -> dict:
    body = text_of(text)
    return {
        "k1": F.xxhash64(body),
        "k2": F.coalesce(F.col(key).cast("long"), F.lit(_LOW + 1)),
        "k3": F.monotonically_increasing_id(),
        "size": F.octet_length(body).cast("long") + 8,
    }


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document; law ``bytes``: shards have nearly equal bytes.

    The size is the text's UTF-8 bytes plus 8; a null text has no bytes and checksum 0. Equal texts
    are neighbours. Slots follow the sort order without gaps.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.crc32(text_of("text").cast("binary")).alias("text_crc32"),
        *[c.alias(n) for n, c in _keys("text", "doc_id").items()])
    done = shard_rows(staged(docs.sortWithinPartitions("k1", "k2"), "shard-keys"))
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_histogram_sort": op1_histogram_sort}
ORACLES: dict[str, str] = {}
