import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import quality
from holdfast.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1
               for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def check(rows, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter(
        (d, *counted(t)) for d, t in docs)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert all(r["kept"] is not None for r in rows)


def test_registered_query(spark, sf):
    docs = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(quality.op5_mcd_quality(spark, sf).collect(), docs)


def test_odd_documents(spark, folder, odd):
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    rows = quality.op5_mcd_quality(spark, folder).collect()
    check(rows, docs)
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert set(range(80)) <= kept and 110 not in kept and 101 not in kept


def test_no_rows(spark, no_rows, no_docs):
    assert quality.op5_mcd_quality(spark, no_rows).collect() == []
    assert quality.keep_good(no_docs).columns == no_docs.columns


def test_stage_keeps_columns_and_verdicts(spark, odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    want = quality.judge_quality(odd).where("kept").select("doc_id").collect()
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in want)


def brute_mcd(x, starts=200, seed=0):
    """Centre and covariance of the subset with the least determinant over random starts."""
    rng = np.random.default_rng(seed)
    h, best = int(np.ceil(quality.SUBSET * len(x))), None
    ridge = np.diag(np.square(quality.SPREAD))
    for _ in range(starts):
        own = rng.choice(len(x), 8, replace=False)
        for _ in range(12):
            m = x[own].mean(axis=0)
            c = np.cov(x[own].T, bias=True) * quality.SUBSET_FACTOR + ridge
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = np.argsort(d)[:h]
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = (det, m, c)
    return best


def test_estimate_against_random_starts(spark):
    """With a third of the rows far away, the centre and the verdicts are those of the brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, [1.0, 0.3, 0.2, 0.3, 0.3], (600, 5)) + 3
    x[:150] = rng.normal(0, 0.2, (150, 5)) + [12, 9, -4, 8, 10]
    frame = spark.createDataFrame([(1, *map(float, r)) for r in x],
                                  "grp long, " + ", ".join(f"{s} double" for s in quality.STATS))
    fit = quality.estimates(frame)
    got = fit.first()
    _, m, _ = brute_mcd(x)
    assert [got[f"m{i}"] for i in range(1, 6)] == pytest.approx(m, abs=0.15)
    far = frame.join(fit.drop("logdet"), "grp").withColumn("d", quality._by_fit())
    out = np.array([r["d"] > quality.REJECT for r in far.orderBy(F.monotonically_increasing_id())
                    .collect()])
    assert out.sum() == 150


def test_distance_equals_linear_algebra(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    frame = spark.createDataFrame([(1, *map(float, r)) for r in x],
                                  "grp long, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = frame.join(quality._fitted(frame, 1.3), "grp").select(
        "x1", quality._by_fit().alias("d")).collect()
    c = np.cov(x.T, bias=True) * 1.3 + np.diag(np.square(quality.SPREAD))
    z = x - x.mean(axis=0)
    want = dict(zip(x[:, 0], np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)))
    for r in got:
        assert r["d"] == pytest.approx(want[r["x1"]], rel=1e-6)


def planted_documents():
    """Two languages and sources with norms of their own; what is usual in one is odd in another."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(4000)]

    def text(n, mark):
        w = list(rng.choice(vocabulary, n))
        return " ".join(x + "#$%&" * (mark and i % 2) for i, x in enumerate(w))

    rows, odd = [], set()
    for lang, source, marked in [("aa", "x", False), ("aa", "y", True), ("bb", "x", True),
                                 ("bb", "y", False)]:
        for i in range(90):
            planted = i % 30 == 7
            if planted:
                odd.add(len(rows))
            rows.append((len(rows), text(int(rng.integers(60, 90)), marked != planted), lang, source))
    return rows, odd


def test_outliers_of_each_pair(spark):
    """Every pair is estimated by itself: texts that are usual in another pair are rejected."""
    rows, odd = planted_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in quality.judge_quality(docs).where("NOT kept").collect()}
    assert gone == odd


def test_limits_are_parameters(spark):
    """Pooled by language the verdicts differ, and with a vast limit nothing is rejected."""
    rows, odd = planted_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pooled = quality.judge_quality(docs, group_rows=91, reject=1e9).collect()
    assert all(r["kept"] for r in pooled)
    assert {r["doc_id"] for r in pooled if r["distance"] > quality.REJECT} != odd
