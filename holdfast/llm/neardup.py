"""Operator 10. N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles. Documents with equal sets are one set. Every set gets
MinHash signatures; bands and rows are chosen so that a pair at the threshold shares a band with the
target recall. Band hashes are shuffled, the sets of a bucket are candidates of each other, and
candidates are verified on their full sets.

Pairs of a bucket are tested inside it, on two bits of every MinHash value: members with its least
one, then those that differ from it with all members, in blocks. Texts of one template that meet in
a bucket by chance end there. A bucket never emits its pairs, only a spanning forest of those that
pass; what the forests connect is verified on full sets, block against block. A block pair is the
unit of a task, and compares its sets by products of membership matrices, so a group of thousands
of near copies is spread over many tasks and gives one row per set and block pair, not one per
link. Links are counted, and only a spanning forest of them leaves a task to form the classes.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import (
    WordArrays, bitmap, distinct, has_bit, mix64, slices, staged, table, text_of, whole_row,
)
from holdfast.llm.lines import LineHashes
from holdfast.session import run_dir

WORDS = 5
THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold shares a band.
RECALL = 0.9999
MOST_HASHES = 400
#: Sets and text bytes of a block, about.
BLOCK_SETS, BLOCK_BYTES = 512, 16 << 20
#: Sets of a block inside a bucket, about.
CELL_SETS = 1024
#: Two bits of each MinHash value, 32 values in a word.
SKETCH_PART, LOW_BITS = 32, 0x5555555555555555
#: Columns of a membership matrix at a time.
COLUMNS = 4096


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL,
                   most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective bands that reach the recall with at most ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def most_different(hashes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Most values whose two bits differ, for all but a tenth of the pairs that bands may miss.

    A value of a pair at the threshold differs with chance ``1 - threshold``, and its bits then in
    three of four cases.
    """
    p, beyond = (1 - threshold) * 3 / 4, 0.0
    for n in range(hashes, 0, -1):
        beyond += math.comb(hashes, n) * p ** n * (1 - p) ** (hashes - n)
        if beyond > (1 - recall) / 10:
            return n
    return 0


def shingles(offsets: np.ndarray, data: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in turn, and where texts start; a short text is one shingle."""
    w = WordArrays(offsets, data)
    n = w.counts()
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    begin = np.cumsum(many) - many
    first = np.repeat((np.cumsum(n) - n) - begin, many) + np.arange(many.sum())
    length = np.repeat(np.minimum(n, size), many)
    return LineHashes(w.hashes()).run(first, first + length), np.append(begin, many.sum())


def signatures(docs: DataFrame, bands: int, rows: int, size: int = WORDS) -> DataFrame:
    """doc_id, t, set hash ``sid``, distinct shingles ``n``, band hashes and sketch; null without words."""
    rng = np.random.default_rng(88)
    factor = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    fold = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    number = mix64(np.arange(1, bands + 1))
    parts = -(-bands * rows // SKETCH_PART)
    place = np.uint64(2) * np.arange(SKETCH_PART, dtype=np.uint64)

    def bits(least: np.ndarray) -> np.ndarray:
        two = np.zeros(parts * SKETCH_PART, np.uint64)
        two[:len(least)] = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
        return (two.reshape(parts, SKETCH_PART) << place).sum(axis=1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, offsets, data in slices(b.column(2)):
                found, begin = shingles(offsets, data, size)
                out, sid, count, sketch = [], [], [], []
                for i in range(last - first):
                    own = np.unique(found[begin[i]:begin[i + 1]])
                    count.append(len(own))
                    sid.append(mix64(own).sum(dtype=np.uint64) + np.uint64(len(own)))
                    if not len(own):
                        out.append(None)
                        sketch.append(None)
                        continue
                    short = (own >> np.uint64(32)).astype(np.uint32)[:, None]
                    least = np.full(bands * rows, 2**32 - 1, np.uint32)
                    for at in range(0, len(own), 256):
                        np.minimum(least, (short[at:at + 256] * factor + shift).min(axis=0),
                                   out=least)
                    out.append(mix64((least.reshape(bands, rows).astype(np.uint64) * fold)
                                     .sum(axis=1, dtype=np.uint64) ^ number).view(np.int64))
                    sketch.append(bits(least).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, last - first), b.column(1).slice(first, last - first),
                    pa.array(mix64(np.array(sid, np.uint64)).view(np.int64)),
                    pa.array(count, pa.int32()), pa.array(out, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ], ["doc_id", "t", "sid", "n", "bands", "sketch"])

    return docs.mapInArrow(
        run, "doc_id long, t long, sid long, n int, bands array<long>, sketch array<long>")


def connected(edges: DataFrame) -> DataFrame:
    """Component of every node of the edges (a, b): columns ``node`` and ``root``, its least node.

    Alternates large-star and small-star steps. Each step's edges are written, so a lost executor
    repeats one step at most, and only counts and a checksum reach the driver.
    """
    spark = edges.sparkSession
    folder = os.path.join(run_dir(spark), f"components-{uuid.uuid4().hex}")

    def written(df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{step}")

    def star(now: DataFrame, large: bool, step: str) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both if large else both.where("b < a")
        # written, so that the join below has two plain exchanges and a hot node can be split
        least = written(seen.groupBy("a").agg(F.min("b").alias("b")).select(
            "a", F.least("a", "b").alias("b")), step).select(
            F.col("a").alias("u"), F.col("b").alias("m"))
        moved = seen.where("b > a") if large else seen
        joined = moved.join(least, moved.a == least.u).select(F.col("b").alias("a"),
                                                              F.col("m").alias("b"))
        if not large:
            joined = joined.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return joined.where("a <> b").distinct()

    now = written(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "0")
    before = None
    for step in range(1, 200):
        large = written(star(now, True, f"{step}-least-large"), f"{step}-large")
        now = written(star(large, False, f"{step}-least-small"), str(step))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle in 200 steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def in_cells(members: DataFrame, most: int) -> DataFrame:
    """Spanning forest (a, b) of the pairs of a cell of which at most ``most`` sketched values differ.

    ``members`` has band, r, x (the cell), role (0: partner, 1: open set, 2: both), sid and sketch.
    Open sets are compared with partners.
    """
    low, last = np.uint64(LOW_BITS), np.iinfo(np.int64).max

    def forest(role: np.ndarray, sid: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        differ = np.zeros((len(up), len(down)), np.uint16)
        for part in sketch.T:
            odd = part[up][:, None] ^ part[down][None, :]
            differ += np.bitwise_count((odd | (odd >> np.uint64(1))) & low)
        linked = (differ <= most) & (sid[up][:, None] != sid[down][None, :])
        above, below = sid[up], sid[down]
        while linked.any():
            new = np.minimum(below, np.where(linked, above[:, None], last).min(axis=0))
            top = np.minimum(above, np.where(linked, new[None, :], last).min(axis=1))
            if (new == below).all() and (top == above).all():
                break
            above, below = top, new
        a, b = np.append(sid[up], sid[down]), np.append(above, below)
        return a[a != b], b[a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                width = len(b.column(5).flatten()) // max(1, b.num_rows)
                new = [np.stack([b.column(i).to_numpy() for i in range(3)], axis=1),
                       b.column(3).to_numpy(), b.column(4).to_numpy(),
                       b.column(5).flatten().to_numpy().view(np.uint64).reshape(-1, width)]
                held = new if held is None else [np.concatenate(c) for c in zip(held, new)]
            if held is None:
                return
            cell = held[0]
            starts = np.append(0, np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1)
            ends = np.append(starts[1:], len(cell))
            done = len(starts) if b is None else len(starts) - 1
            found = [forest(*[c[a:z] for c in held[1:]]) for a, z in zip(starts[:done], ends[:done])]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found])) for i in range(2)], ["a", "b"])
                held = [c[ends[done - 1]:] for c in held] if b is not None else None

    return (members.select("band", F.col("r").cast("long"), F.col("x").cast("long"), "role", "sid",
                           "sketch")
            .repartition("band", "r", "x").sortWithinPartitions("band", "r", "x")
            .mapInArrow(run, "a long, b long"))


def plausible(sets: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect the sets of a bucket whose sketches differ in ``most`` values at most.

    ``sets`` has sid, bands and sketch. Each member is tested with the least one of its bucket, a
    pair once for all its buckets. Members that fail are open; blocks of them are compared with
    blocks of all members. Members that passed are connected already and not compared again, so a
    group of near copies costs one test for each member and bucket, whatever its size.
    """
    in_bands = sets.select("sid", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("sid").alias("b"), F.count("*").alias("n")) \
        .where("n > 1")
    members = staged(in_bands.join(buckets, "band").select("band", "n", "sid", "b"), "band-members")
    sketches = sets.select("sid", "sketch")
    centres = sets.select(F.col("sid").alias("b"), F.col("sketch").alias("centre"))
    odd = F.zip_with("sketch", "centre", lambda x, y: x.bitwiseXOR(y))
    differ = F.aggregate(odd, F.lit(0), lambda n, x: n + F.bit_count(
        x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW_BITS))))
    tested = staged(members.where("sid <> b").select("sid", "b").distinct().join(sketches, "sid").join(
        centres, "b").select("sid", "b", (differ <= most).alias("passed")), "centre-pairs")
    opened = tested.where("NOT passed").select("sid", "b", F.lit(True).alias("open"))
    marked = staged(members.where("n > 2").join(opened, ["sid", "b"], "left").select(
        "band", "n", "sid", F.coalesce("open", F.lit(False)).alias("open")), "open-members")
    cells = marked.where("open").groupBy("band").agg(F.count("*").alias("n_open"))
    placed = marked.join(cells, "band").join(sketches, "sid").select(
        "band", "sid", "sketch", "open", F.ceil(F.col("n") / CELL_SETS).cast("int").alias("k"),
        F.ceil(F.col("n_open") / CELL_SETS).cast("int").alias("k_open")).withColumn(
        "single", (F.col("k") == 1) & (F.col("k_open") == 1))
    partners = placed.select(
        "band", F.explode(F.sequence(F.lit(0), F.col("k_open") - 1)).alias("r"),
        F.pmod(F.hash("sid"), "k").alias("x"),
        F.when(F.col("single") & F.col("open"), 2).otherwise(0).alias("role"), "sid", "sketch")
    opens = placed.where("open AND NOT single").select(
        "band", F.pmod(F.hash("sid"), "k_open").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"), F.lit(1).alias("role"), "sid",
        "sketch")
    return tested.where("passed").select(F.col("sid").alias("a"), "b").unionByName(
        in_cells(partners.unionByName(opens), most))


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with other sets at ``right``.

    Elements of one set only are left out, so a set meets itself in too few.
    """
    values, _, number = distinct(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(number, minlength=len(values)) > 1
    keep = often[number]
    column, owner = (np.cumsum(often) - 1)[number[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(often.sum())
    out = np.zeros((len(left), len(right)), np.float32 if width < 1 << 24 else np.float64)
    for at in range(0, width, COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, width - at)), out.dtype)
        matrix[owner[a:z], column[a:z] - at] = 1
        out += matrix[left] @ matrix[right].T
    return out


def verify(members: DataFrame, threshold: float, size: int = WORDS) -> DataFrame:
    """Links inside block pairs: per set its links, and the least set it is connected with there.

    ``members`` has root, i, j (the block pair), own (its block), sid, copies and text.
    """
    part = Fraction(str(threshold))

    def judged(group: list[tuple]) -> tuple[list, list, list, list]:
        sid = np.array([g[1] for g in group], np.int64)
        copies = np.array([g[2] for g in group], np.float64)
        block = np.array([g[0] for g in group])
        sets = []
        for _, _, offsets, data in slices(pa.array([g[3] for g in group], pa.string())):
            found, begin = shingles(offsets, data, size)
            sets.extend(np.unique(found[a:z]) for a, z in zip(begin[:-1], begin[1:]))
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        n = np.array([len(s) for s in sets], np.float64)
        shared = overlaps(sets, left, right).astype(np.float64)
        linked = shared * part.denominator >= part.numerator * (
            n[left][:, None] + n[right][None, :] - shared)
        linked &= sid[left][:, None] != sid[right][None, :]
        whole = np.zeros((len(sid), len(sid)), bool)
        whole[np.ix_(left, right)] = linked
        whole |= whole.T
        root = sid.copy()
        while True:
            near = np.where(whole, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            new = np.minimum(root, near)
            if (new == root).all():
                break
            root = new
        return sid, whole.sum(axis=1), (whole @ copies), root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def paired() -> bool:
            # a block without sets leaves the other one alone, which is compared with itself elsewhere
            return len(group) > 1 and (now[1] == now[2] or len({g[0] for g in group}) == 2)

        def given() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(4)],
                ["sid", "texts", "docs", "least"])
            out.clear()
            return rows

        for b in batches:
            cells = [b.column(i).to_pylist() for i in range(7)]
            for root, i, j, *row in zip(*cells):
                if (root, i, j) != now:
                    if paired():
                        out.append(judged(group))
                    now, group = (root, i, j), []
                group.append(row)
            if out:
                yield given()
        if paired():
            out.append(judged(group))
        if out:
            yield given()

    return (members.select("root", "i", "j", "own", "sid", "copies", "text")
            .repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
            .mapInArrow(run, "sid long, texts long, docs long, least long"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, t (hash of the text), class_id, n_links, n_text_links, leader.

    Documents are linked when the Jaccard similarity of their shingle sets reaches the threshold.
    ``class_id`` is the least id that links connect a document with, ``n_links`` counts the other
    documents it is linked with, copies included, ``n_text_links`` the other sets. ``leader`` marks
    the document of its class with the least (id, t); rows that repeat it are marked too.

    Texts of one to four words are one shingle. Null, empty and blank texts have no links and are
    their own class. Null ids come last. Other columns are not read. An empty table gives no rows.
    """
    bands, rows = bands_and_rows(threshold, recall)
    own = docs.select(docs[key].cast("long").alias("doc_id"),
                      F.xxhash64(text_of(docs[text])).alias("t"), docs[text].alias("text"))
    signed = staged(signatures(own, bands, rows), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    sets = staged(signed.where("n > 0").groupBy("sid").agg(
        F.min(place).alias("at"), F.count("*").alias("copies"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    candidates = connected(plausible(sets, most_different(bands * rows, threshold, recall)))
    named = sets.select("sid", "at", "copies").join(
        candidates.withColumnRenamed("node", "sid"), "sid")
    wanted = staged(named.select(F.col("at.doc_id").alias("w_doc"), F.col("at.t").alias("w_t"), "sid",
                                 "copies", "root"), "wanted")
    marks = bitmap(wanted, "w_t")

    @F.pandas_udf("boolean")
    def marked(t: pd.Series) -> pd.Series:
        return pd.Series(has_bit(marks, t.to_numpy()))

    texts = staged(own.where(marked("t")).join(wanted, (F.col("t") == F.col("w_t"))
                                               & F.col("doc_id").eqNullSafe(F.col("w_doc")))
                   .select("sid", "copies", "root", "text").dropDuplicates(["sid"]), "set-texts")
    blocks = texts.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES))
        .cast("int").alias("k"))
    spread = texts.join(blocks, "root").withColumn("own", F.pmod(F.hash("sid"), "k")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "root", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "sid",
        "copies", "text")
    linked = staged(verify(spread, threshold), "links")
    links = linked.groupBy("sid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    classes = connected(linked.select(F.col("sid").alias("a"), F.col("least").alias("b"))
                        .where("a <> b"))
    per_set = sets.select("sid", "at", "copies").join(
        classes.withColumnRenamed("node", "sid"), "sid", "left").join(links, "sid", "left").select(
        "sid", "at", "copies", F.coalesce("root", "sid").alias("root"),
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    per_set = staged(per_set, "set-classes")
    best = per_set.groupBy("root").agg(F.min("at").alias("best"))
    known = per_set.join(best, "root").select(
        F.col("sid").alias("k_sid"), "copies", "texts", "docs", "best")
    alone = F.col("best").isNull()
    return signed.select("doc_id", "t", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(
        known, F.coalesce("sid", F.xxhash64("doc_id", "t")) == F.col("k_sid"), "left").select(
        "doc_id", "t",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("docs") + F.col("copies") - 1).cast("long")
        .alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        (alone | (F.col("best") == place)).alias("leader"))


def keep_leaders(docs: DataFrame) -> DataFrame:
    """One document of every class, the leader, with all its columns.

    Only documents whose text hash shares its bit with one that goes, or with a repeated row, are
    shuffled.
    """
    classes = staged(near_classes(docs).select("doc_id", "t", "leader"), "leaders")
    per_row = classes.groupBy("doc_id", "t").agg(F.count("*").alias("n"),
                                                 F.first("leader").alias("leader"))
    going = staged(per_row.where("n > 1 OR NOT leader"), "going")
    bits = bitmap(going, "t")

    @F.pandas_udf("boolean")
    def touched(t: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bits, t.to_numpy()))

    base = docs.select(whole_row(docs.columns).alias("_row"), F.xxhash64(text_of("text")).alias("_t"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id")) \
        .withColumn("_hit", touched("_t"))
    drop = going.where("NOT leader").select(
        F.col("t").alias("_t"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"))
    left = base.where("_hit").join(drop, ["_t", "_id"], "left_anti").dropDuplicates(["_t", "_id"])
    return base.where("NOT _hit").unionByName(left).select("_row.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document at a shingle similarity of 0.8."""
    return near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "n_text_links")


#: Classes and links of a table ``given`` of documents, by comparing all sets that share a shingle.
CLASSES_SQL = rf"""
w0 AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM given
), s0 AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(
    range(greatest(len(w) - {WORDS - 1}, least(len(w), 1))),
    lambda i: array_to_string(w[i + 1:i + {WORDS}], ' ')))) AS s FROM w0
), sets AS (
  SELECT s, min(doc_id) AS sid, count(*) AS copies, len(s) AS n FROM s0 WHERE len(s) > 0 GROUP BY s
), elements AS (
  SELECT sid, n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM elements a JOIN elements b ON a.x = b.x AND a.sid < b.sid GROUP BY 1, 2
), half AS (
  SELECT a, b FROM shared WHERE both_ * 5 >= 4 * (na + nb - both_)
), links AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach AS (
  SELECT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), roots AS (
  SELECT a AS sid, min(b) AS class_id FROM reach GROUP BY a
), per_set AS (
  SELECT sets.sid, sets.s, sets.copies, coalesce(any_value(roots.class_id), sets.sid) AS class_id,
    count(links.b) AS texts, coalesce(sum(o.copies), 0) AS docs
  FROM sets LEFT JOIN roots USING (sid) LEFT JOIN links ON links.a = sets.sid
  LEFT JOIN sets o ON o.sid = links.b GROUP BY sets.sid, sets.s, sets.copies
), classed AS (
  SELECT s0.doc_id, coalesce(p.class_id, s0.doc_id) AS class_id,
    CAST(coalesce(p.docs + p.copies - 1, 0) AS BIGINT) AS n_links,
    coalesce(p.texts, 0) AS n_text_links
  FROM s0 LEFT JOIN per_set p ON p.s = s0.s
)"""

QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES = {"op10_ngram_jaccard": f"""WITH RECURSIVE given AS (SELECT doc_id, text FROM documents),
{CLASSES_SQL} SELECT doc_id, class_id, n_links, n_text_links FROM classed"""}
