import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from holdfast.llm import scoring
from holdfast.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def symbols(words):
    return [scoring.START] * scoring.ORDER + list(" ".join(words).encode()) + [scoring.END]


class Brute:
    """Prediction by partial matching with dictionaries, one byte at a time."""

    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(scoring.ORDER + 1)]
        for words in texts:
            s = symbols(words)
            for i in range(scoring.ORDER, len(s)):
                for j in range(scoring.ORDER + 1):
                    self.seen[j][bytes(s[i - j:i])][s[i]] += 1

    def byte(self, s, i):
        out, gone = 0.0, set()
        for j in range(scoring.ORDER, -1, -1):
            counts = self.seen[j].get(bytes(s[i - j:i]))
            if not counts:
                continue
            left = {a: n for a, n in counts.items() if a not in gone}
            gone |= set(counts)
            if not left:
                continue
            whole = 2 * sum(left.values())
            if s[i] in left:
                return out + math.log10((2 * left[s[i]] - 1) / whole)
            out += math.log10(len(left) / whole)
        return out - math.log10(max(1, scoring.SYMBOLS - len(gone)))

    def score(self, words):
        s = symbols(words)
        return sum(self.byte(s, i) for i in range(scoring.ORDER, len(s)))


def check(rows, docs, scored=60):
    docs = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    train = [w for d, w in docs if not held[d]]
    count = Counter(x for w in train for x in w)
    total, distinct = sum(count.values()) + len(train), len(count) + bool(train)
    unit = math.log10(total + distinct + 1)
    model = Brute(train)
    want = sorted(((d is None, d or 0, len(w) + 1), d, w) for d, w in docs)
    got = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    assert len(want) == len(got)
    for i, ((_, d, w), r) in enumerate(zip(want, got)):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (
            d, held[d], len(w) + 1, total)
        assert r["n_known"] == sum(x in count for x in w) + bool(train)
        base = sum(math.log10(count[x] + 1) - unit for x in w) + math.log10(len(train) + 1) - unit
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if i < scored:
            assert r["score"] == pytest.approx(model.score(w), rel=1e-9)


def test_registered_query(spark, sf):
    docs = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(scoring.op2_ppm_scores(spark, sf).collect(), docs)


def test_odd_documents(spark, folder, odd):
    docs = [(r[0], r[1]) for r in odd.where("doc_id IS NULL OR doc_id NOT IN (105, 5)")
            .select("doc_id", "text").collect()]
    rows = scoring.score(odd.where("doc_id IS NULL OR doc_id NOT IN (105, 5)"),
                         F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    check(rows, docs, 200)
    assert scoring.op2_ppm_scores(spark, folder).count() == odd.count()


def test_no_rows(spark, no_rows):
    assert scoring.op2_ppm_scores(spark, no_rows).collect() == []


def test_no_training_rows(spark):
    frame = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scoring.score(frame, F.lit(True)).collect()}
    assert got[1]["score"] == pytest.approx(-5 * math.log10(256))
    assert got[2]["score"] == pytest.approx(-math.log10(256))
    assert got[1]["n_known"] == got[1]["train_tokens"] == 0


def test_rare_words_by_shuffle_equal_words_in_the_task(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.col("doc_id") % 5 == 0
    one = {r["doc_id"]: r for r in scoring.score(docs, held).collect()}
    two = {r["doc_id"]: r for r in scoring.score(docs, held, head=10).collect()}
    for d, r in one.items():
        assert r["n_known"] == two[d]["n_known"]
        assert r["base_score"] == pytest.approx(two[d]["base_score"], rel=1e-9)


@pytest.mark.parametrize("capacity", [0, 50])
def test_pairs_above_the_bound_are_joined(spark, odd, monkeypatch, capacity):
    """Scores do not depend on how many pairs are looked up in the task."""
    monkeypatch.setattr(scoring, "VALUED", 100)
    frame = odd.where("doc_id IS NULL OR doc_id NOT IN (105, 5)")
    docs = [(r[0], r[1]) for r in frame.select("doc_id", "text").collect()]
    check(scoring.score(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2,
                        capacity=capacity).collect(), docs, 200)


def test_distribution_sums_to_one(spark):
    """All bytes after any context have probability one together, also with few entries kept."""
    import numpy as np
    import pyarrow as pa

    from holdfast.llm.common import WordArrays, distinct, slices
    keys = np.concatenate([scoring.contexts(*scoring.symbols(WordArrays(o, d)), 3) for _, _, o, d in
                           slices(pa.array(["abra cadabra", "bra bra cab", "", "a b c"]))])
    tables = []
    for j in range(4):
        part = keys >> 8 * (3 - j) + 8 << 8 | keys & 255
        values, _, number = distinct(part)
        n = np.bincount(number)
        tables.append((values[n >= 1 + (j > 2)], n[n >= 1 + (j > 2)]))
    trie = scoring.Trie(tables)
    for context in np.unique(keys >> 8).tolist() + [0x7A7A7A]:
        every = np.array([context << 8 | b for b in range(256)], np.int64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1.0)


def test_least_count(spark):
    frame = spark.range(1000).selectExpr("id % 10 + 1 AS n")
    assert scoring.least_count(frame, 250) == 9
    assert scoring.least_count(frame, 10_000) == 1
    assert frame.where(f"n >= {scoring.least_count(frame, 99)}").count() == 0
