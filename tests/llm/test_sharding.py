import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import sharding
from holdfast.llm.common import table


def check(rows, docs, tolerance):
    size = {}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
        size[r["doc_id"]] = r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(total.values()) / 24
    largest = max(r["size"] for r in rows)
    assert max(total.values()) - mean <= largest + tolerance * mean


def test_registered_query(spark, sf):
    docs = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(sharding.op1_histogram_sort(spark, sf).collect(), docs, 0.05)


def test_odd_documents(spark, folder, odd):
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    check(sharding.op1_histogram_sort(spark, folder).collect(), docs, 0.1)


def test_no_rows(spark, no_rows):
    assert sharding.op1_histogram_sort(spark, no_rows).collect() == []


def test_hot_key_is_split_between_ids(spark):
    """One text that two thirds of the rows share: equal shards, copies in neighbouring ones."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.xxhash64("id")).alias("k1"),
        F.col("id").alias("k2"), F.lit(100).cast("long").alias("size"))
    done = sharding.shard_rows(rows, 12, 4).groupBy("shard").count().collect()
    assert len(done) == 12
    assert max(abs(r["count"] - 2500) for r in done) <= 10


@pytest.mark.parametrize("doc_id", [9999, None])
def test_hot_row_is_split(spark, tmp_path, doc_id):
    """One row many times over, also without id: equal shards."""
    rows = [(i, f"text {i} " * 3) for i in range(2400)] + [(doc_id, "again and again " * 2)] * 1200
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(
        f"{tmp_path}/documents.parquet")
    check(sharding.op1_histogram_sort(spark, str(tmp_path)).collect(), rows, 0.05)
    got = sharding.op1_histogram_sort(spark, str(tmp_path)).groupBy("shard").agg(
        F.sum("size").alias("size")).collect()
    mean = sum(r["size"] for r in got) / 24
    assert len(got) == 24 and max(abs(r["size"] - mean) for r in got) <= 0.05 * mean


def test_small_groups_stay_whole(spark):
    """Copies that are small against a shard share one."""
    rows = spark.range(40_000).select(
        F.xxhash64((F.col("id") / 10).cast("long")).alias("k1"), F.col("id").alias("k2"),
        F.lit(50).cast("long").alias("size"))
    done = sharding.shard_rows(rows, 8, 2)
    assert done.groupBy("k1").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_positions(seed):
    rng = np.random.default_rng(seed)
    k1, k2 = rng.integers(0, 6, 200), rng.integers(0, 9, 200)
    order = np.lexsort((k2, k1))
    keys = sorted(zip(k1.tolist(), k2.tolist()))
    at = [(a, b) for a in range(-1, 8) for b in range(-1, 11)]
    got = sharding.positions(k1[order], k2[order], at)
    assert got.tolist() == [sum(k < p for k in keys) for p in at]


def test_written_shards_hold_all_documents(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("k1", "size", "shard"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count()
    assert {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))


def test_large_shards_have_more_ranges(spark, odd, tmp_path, monkeypatch):
    """Ranges grow with the bytes; each is one file, and files of a shard hold disjoint ranges."""
    monkeypatch.setattr(sharding, "PIECE_BYTES", 2_000)
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sharding.write_shards(rows, str(tmp_path / "out"), shards=2)
    back = spark.read.parquet(str(tmp_path / "out")).select(
        "doc_id", "shard", F.input_file_name().alias("file"), F.xxhash64("text").alias("h"))
    files = back.groupBy("shard", "file").agg(F.count("*").alias("n"), F.min("h"), F.max("h")).collect()
    assert back.count() == 6000 and 50 <= len(files) <= 60
    assert max(f["n"] for f in files) < 2 * min(f["n"] for f in files)
    spans = sorted((f["min(h)"], f["max(h)"]) for f in files)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sharding.pieces_of(rows.select(F.lit(8).cast("long").alias("size")), 2) == sharding.PIECES


def test_boundary_at_the_end_of_a_cell():
    """A target that is where a bracket begins settles there, not in the cell before."""
    key = lambda n: (n, 0, 0)
    cells = [{"least": key(i), "most": key(i), "size": 10} for i in range(4)]
    b = sharding.Bracket(20, key(2), key(3), 20)
    b.below = 20
    b.narrow(cells, [10, 20, 30, 40], 0.0, 0.0)
    assert b.found == key(2) and (b.below, b.inside) == (20, 10)
