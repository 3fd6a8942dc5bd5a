import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from compare import connect, difference
from holdfast.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_registered_query(spark, sf):
    assert difference(mixing.op4_mixing_tree(spark, sf), connect(sf),
                      mixing.ORACLES["op4_mixing_tree"]) is None


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if part[s] > most * sizes[s]}
        if not above:
            return out | part
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_odd_documents(spark, folder, odd):
    rows = mixing.op4_mixing_tree(spark, folder).collect()
    docs = odd.select("doc_id", "text", "source").collect()
    assert sorted(str((r["doc_id"], r["size"])) for r in rows) == sorted(
        str((d, len(WORD.findall(t or "")))) for d, t, _ in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    want = sorted(filled(sizes).values())
    got = {(r["source_size"], r["target"]): 0 for r in rows}
    assert sorted({t for _, t in got}) == pytest.approx(sorted(set(want)))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source_size"], r["target"]] += r["taken"]
    by_source = defaultdict(set)
    for s, n in sizes.items():
        by_source[n].add(s)
    for (n, target), taken in got.items():
        assert abs(taken - len(by_source[n]) * target) <= len(by_source[n])


def test_no_rows(spark, no_rows):
    assert mixing.op4_mixing_tree(spark, no_rows).collect() == []


def test_reruns_agree(spark, folder):
    def run():
        return sorted(map(str, mixing.op4_mixing_tree(spark, folder).collect()))
    assert run() == run()


def test_pieces_are_disjoint_and_shards_equal(spark, sf):
    docs, pieces = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), shards=5)
    spans, blocks = defaultdict(list), defaultdict(set)
    for r in pieces.collect():
        spans[r["pool"], r["bucket"], r["row"], r["pass"]].append((r["start"], r["length"]))
        blocks[r["shard"]].add((r["pool"], r["pass"], r["order"]))
    for s in spans.values():
        end = 0
        for start, length in sorted(s):
            assert start >= end
            end = start + length
    n = [len(b) for b in blocks.values()]
    assert len(n) == 5 and max(n) - min(n) <= 1
    assert docs.count() == 200


def test_tree_is_exact():
    quotas = [17, 0, 1, 300, 45]
    out = mixing.split_quotas(quotas, 7)
    assert out.sum(axis=0).tolist() == quotas
    assert (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 1
    assert (out == mixing.split_quotas(quotas, 7)).all()


def test_mixed_documents(spark, odd):
    """Words of the mix are those taken, in order; whole documents keep their text."""
    docs = odd.drop("size", "target", "n", "row", "place", "bucket")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = defaultdict(set)
    for d, t in docs.select("doc_id", "text").collect():
        texts[d].add(t)
    words = defaultdict(int)
    for d, t in mixed.select("doc_id", "text").collect():
        own = [x for x in texts[d] if x is not None]
        assert any(t == x or set(WORD.findall(t)) <= set(WORD.findall(x)) for x in own)
        words[d] += len(WORD.findall(t))
    rows, pieces = mixing.mix(docs)
    taken = pieces.groupBy("doc_id").sum("length").collect()
    assert dict(words) == {r[0]: r[1] for r in taken}
    assert rows.count() == docs.count()


def test_mixed_documents_come_in_the_order_of_their_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = defaultdict(dict)
    for r in mixing.mix(docs)[1].collect():
        own = first[r["doc_id"]]
        own[r["pass"]] = min(own.get(r["pass"], (1 << 60, 0, 0)), (r["start"], r["shard"], r["order"]))
    once = {d: next(iter(p.values()))[1:] for d, p in first.items() if len(p) == 1}
    assert len(once) > 20
    parts, slices = defaultdict(list), defaultdict(set)
    for d, part in mixing.mixed_documents(docs).select(
            "doc_id", F.spark_partition_id()).collect():
        if d in once:
            parts[part].append(once[d])
            shard, order = once[d]
            slices[shard, order >> 4 * mixing._HEX - mixing.SLICE_BITS].add(part)
    assert all(p == sorted(p) for p in parts.values())
    assert all(len(s) == 1 for s in slices.values())
