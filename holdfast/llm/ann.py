"""Operator 6. Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products are nearest points once vectors are divided by the greatest length, get one
more coordinate that brings them to length one, and queries are brought to length one with a zero
there. Vectors are hashed in bands of lengths, each with its own greatest length, so ``WIDTH`` does
not depend on the scale of the vectors, and a few long ones do not move the others together. A query
visits every band. Each of ``TABLES`` tables hashes a point with
``FUNCTIONS`` functions ``floor((a x + b) / WIDTH)``, ``a`` normal. A query visits the ``PROBES``
buckets of a table that are likeliest to hold near points: its own, and neighbours in the order of
the summed squared distances to the cell borders that have to be crossed. All vectors of the visited
buckets are candidates; they are ranked by the exact inner product, and the lists of all buckets are
merged. There is no cap on buckets or candidates. Queries that find too few rows visit all neighbours
of their buckets, and those that still do, all vectors.

Equal vectors are one point, with the least ids that an answer can need, so a vector that a third of
the rows share is ranked once. Buckets above ``BUCKET_ROWS`` points are split over tasks, and a query
visits every part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import mix64, staged, table

NEIGHBOURS = 20
TABLES, FUNCTIONS, WIDTH, PROBES = 8, 4, 1.5, 14
#: Bands of lengths for each factor of two.
BANDS = 1
BUCKET_ROWS = 4096
SEED = 5
#: Rows (bucket, p, vector) that a task hands on at a time.
ROWS_AT_ONCE = 1 << 16
#: Queries that are ranked against a bucket at a time.
QUERIES_AT_ONCE = 256


def valid(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, not zero, and holds finite numbers only."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~F.coalesce(odd, F.lit(True))
                         & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def points(rows: DataFrame, ids: int) -> DataFrame:
    """Distinct vectors: ``p`` (hash), ``vector``, and ``ids``, the least ids of its rows."""
    keyed = rows.select("vec_id", F.xxhash64("vector").alias("p"), "vector")

    # a task's rows of one vector give its least ids only, then parts of a vector, then the vector
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, own = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
            order = np.lexsort((own, p))
            new = np.ones(len(p), bool)
            new[1:] = p[order][1:] != p[order][:-1]
            start = np.flatnonzero(new)
            rank = np.arange(len(p)) - np.repeat(start, np.diff(start, append=len(p)))
            yield b.take(pa.array(order[rank < ids]))

    some = keyed.select("vec_id", "p").mapInArrow(least, "vec_id long, p long")
    for parts in (32, 1):
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        some = some.groupBy("p", part.alias("part")).agg(F.slice(F.sort_array(
            F.collect_list("vec_id")), 1, ids).alias("ids")).select(
            "p", F.explode("ids").alias("vec_id"))
    lists = some.groupBy("p").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return keyed.groupBy("p").agg(F.first("vector").alias("vector")).join(lists, "p")


class Hashes:
    """The tables' functions for vectors of one size and band, and visits in order of success."""

    def __init__(self, size: int, reach: float, width: float, tables: int, functions: int,
                 band: int = 0):
        rng = np.random.default_rng(SEED + size)
        self.a = rng.standard_normal((size + 1, tables * functions))
        self.b = rng.random(tables * functions) * width
        self.reach, self.width, self.shape = reach, width, (-1, tables, functions)
        self.marks = mix64(np.arange(1, tables + 1) * 1_000_003 + size + (band << 40))
        self.fold = mix64(np.arange(1, functions + 1)) | np.uint64(1)
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=functions)))

    def _cells(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / (np.sqrt((x * x).sum(axis=1))[:, None] if query else self.reach)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0.0))
        return ((np.column_stack([x, rest]) @ self.a + self.b) / self.width).reshape(self.shape)

    def _key(self, cells: np.ndarray) -> np.ndarray:
        whole = (cells.astype(np.int64).view(np.uint64) * self.fold).sum(axis=-1, dtype=np.uint64)
        marks = self.marks.reshape((1, -1) + (1,) * (whole.ndim - 2))
        return mix64(whole ^ marks).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each point in each table."""
        return self._key(np.floor(self._cells(x, False)))

    def visits(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Buckets that each query visits in each table, likeliest first."""
        spot = self._cells(x, True)
        cell = np.floor(spot)
        below = ((spot - cell) * self.width) ** 2
        above = ((cell + 1 - spot) * self.width) ** 2
        cost = below @ (self.moves == -1).T + above @ (self.moves == 1).T
        order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        return self._key(cell[..., None, :] + self.moves[order])


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix for each length of vector."""
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    return [(rows, flat[begin[rows][:, None] + np.arange(n)])
            for n in np.unique(size) for rows in [np.flatnonzero(size == n)]]


def hashed(found: DataFrame, reach: dict[int, float], query: bool, probes: int = PROBES,
           width: float = WIDTH, tables: int = TABLES, functions: int = FUNCTIONS) -> DataFrame:
    """Rows (bucket, p, vector): of every point in each table, or of every query's visits.

    ``reach`` has the greatest length of each band.
    """
    at_once = max(1, ROWS_AT_ONCE // (tables * (probes if query else 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], Hashes] = {}
        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            for rows, x in _matrix(b.column(1)):
                n = x.shape[1]
                for band in reach if query else np.unique(own[rows]).tolist():
                    if (n, band) not in known:
                        known[n, band] = Hashes(n, reach[band], width, tables, functions, band)
                    h = known[n, band]
                    here = np.arange(len(rows)) if query else np.flatnonzero(own[rows] == band)
                    for at in range(0, len(here), at_once):
                        some = here[at:at + at_once]
                        keys = h.visits(x[some], probes) if query else h.buckets(x[some])
                        keys = keys.reshape(len(some), -1)
                        place = pa.array(np.repeat(rows[some], keys.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), b.column(0).take(place),
                             b.column(1).take(place)], ["bucket", "p", "vector"])

    return found.select("p", "vector", "band").mapInArrow(
        run, "bucket long, p long, vector array<float>")


def ranked(index: DataFrame, visits: DataFrame, keep: int) -> DataFrame:
    """Per visit the ``keep`` points of the bucket with the largest inner products: q, p, score."""
    both = index.select("bucket", "part", F.lit(0).alias("side"), "p", "vector").unionByName(
        visits.select("bucket", "part", F.lit(1).alias("side"), "p", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names = None, ["q", "p", "score"]
        held: list = []
        asked: list = []

        def answers() -> Iterator[pa.RecordBatch]:
            if held and asked:
                own = {}
                for column, p in held:
                    for rows, x in _matrix(column):
                        own.setdefault(x.shape[1], []).append((p[rows], x))
                for column, q in asked:
                    for rows, x in _matrix(column):
                        if x.shape[1] not in own:
                            continue
                        p = np.concatenate([o[0] for o in own[x.shape[1]]])
                        base = np.concatenate([o[1] for o in own[x.shape[1]]])
                        for at in range(0, len(rows), QUERIES_AT_ONCE):
                            some = x[at:at + QUERIES_AT_ONCE]
                            best = some @ base.T
                            if keep < len(p):
                                best = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
                            else:
                                best = np.tile(np.arange(len(p)), (len(some), 1))
                            # the same pair gives the same sum in whatever bucket it meets
                            score = (some[:, None, :] * base[best]).sum(axis=-1)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.repeat(q[rows[at:at + QUERIES_AT_ONCE]],
                                                   best.shape[1])),
                                pa.array(p[best].ravel()), pa.array(score.ravel())], names)
            asked.clear()

        for b in batches:
            bucket, part, side = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            p = b.column(3).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
                                    | (side[1:] != side[:-1])) + 1
            for a, z in zip([0, *change], [*change, len(bucket)]):
                if a == z:
                    continue
                if (bucket[a], part[a]) != now:
                    yield from answers()
                    now = (bucket[a], part[a])
                    held.clear()
                (asked if side[a] else held).append((b.column(4).slice(a, z - a), p[a:z]))
            yield from answers()

    return (both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")
            .mapInArrow(run, "q long, p long, score double"))


def search(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding",
           neighbours: int = NEIGHBOURS, probes: int = PROBES) -> DataFrame:
    """The nearest rows of every query row: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller id. A row is no
    neighbour of its own. Vectors that are null, zero, or hold null or non-finite numbers take no
    part, and vectors of different length are never neighbours. Ids should be distinct; a row whose
    id is null takes no part. Other columns are not read. An empty table gives no rows. A query gets
    ``neighbours`` rows, or all others of its length where there are fewer.
    """
    rows = staged(valid(vectors.select(vectors[key].cast("long").alias("vec_id"),
                                       vectors[column].cast("array<float>").alias("vector"),
                                       is_query.alias("asks")), "vector")
                  .where("vec_id IS NOT NULL"), "vectors")
    length = F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = staged(points(rows, neighbours + 1).withColumn("length", length).withColumn(
        "band", F.round(F.log2("length") * BANDS).cast("int")), "points")
    reach = {r["band"]: r["reach"] for r in found.groupBy("band").agg(
        F.max("length").alias("reach")).collect()}
    asks = staged(rows.where("asks").select("vec_id", F.xxhash64("vector").alias("p")), "queries")
    wanted = found.join(asks.select("p").distinct(), "p", "left_semi")
    index = staged(hashed(found, reach, False, probes), "buckets")
    by_size = F.size("vector").cast("long").alias("bucket")

    def visited(index: DataFrame, visits: DataFrame, step: str) -> DataFrame:
        sizes = index.groupBy("bucket").agg(
            F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts"))
        split = index.join(sizes, "bucket").withColumn("part", F.pmod(F.hash("p"), "parts"))
        visits = visits.join(sizes, "bucket").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return staged(ranked(split, visits, neighbours + 1).groupBy("q", "p").agg(
            F.max("score").alias("score")), f"pairs-{step}")

    pairs = visited(index, hashed(wanted, reach, True, probes), "first")
    counted = found.select("p", F.size("ids").alias("rows"))
    for step in ("neighbours", "all"):
        # rows found without the asking one, which may be missing
        got = pairs.join(counted, "p").groupBy(F.col("q").alias("p")).agg(
            (F.sum("rows") - F.max((F.col("p") == F.col("q")).cast("int"))).alias("got"))
        short = staged(wanted.join(got, "p", "left").where(
            F.coalesce("got", F.lit(0)) < neighbours).select("p", "vector", "band"),
            f"short-{step}")
        if short.isEmpty():
            break
        more = visited(index, hashed(short, reach, True, 3 ** FUNCTIONS), step) \
            if step == "neighbours" else visited(
                found.select(by_size, "p", "vector"), short.select(by_size, "p", "vector"), step)
        pairs = pairs.join(short.select(F.col("p").alias("q")), "q", "left_anti").unionByName(more)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    lists = found.select("p", "ids", F.col("ids")[0].alias("least"))
    near = pairs.join(lists, "p").withColumn("place", F.row_number().over(best)).where(
        F.col("place") <= neighbours + 1).groupBy("q").agg(
        F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("near"))
    # of the points in order, ids in order: all rows of a query's answer fit in one short array
    flat = F.flatten(F.transform("near", lambda c: F.transform(
        c["ids"], lambda i: F.struct(c["far"].alias("far"), i.alias("id")))))
    answer = F.slice(F.sort_array(F.filter(flat, lambda x: x["id"] != F.col("vec_id"))),
                     1, neighbours)
    return asks.join(near, asks.p == near.q).select(
        F.col("vec_id").alias("query_id"), F.posexplode(answer).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"),
        (-F.col("hit.far")).alias("score"))


def op6_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row of ``embeddings`` whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_multiprobe_search": op6_multiprobe_search}
ORACLES: dict[str, str] = {}
