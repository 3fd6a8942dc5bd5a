import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import connect, difference
from holdfast.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(docs):
    """(class, links, set links) per position, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    label, links, others = list(range(n)), [0] * n, [set() for _ in range(n)]
    near = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) * 5
             >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    for i in range(n):
        links[i] = len(near[i])
        others[i] = {sets[j] for j in near[i]} - {sets[i]}
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *(label[j] for j in near[i])])
            changed |= least != label[i]
            label[i] = least
    out = []
    for i, (d, _) in enumerate(docs):
        own = [docs[j][0] for j in range(n) if label[j] == label[i] and docs[j][0] is not None]
        out.append((min(own) if own else d, links[i], len(others[i])))
    return out


def test_registered_query(spark, sf):
    assert difference(neardup.op10_ngram_jaccard(spark, sf), connect(sf),
                      neardup.ORACLES["op10_ngram_jaccard"]) is None


def test_odd_documents(spark, odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = neardup.near_classes(odd).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in got) == \
        Counter((d, *b) for (d, _), b in zip(docs, brute(docs)))


def test_no_rows(spark, no_rows, no_docs):
    assert neardup.op10_ngram_jaccard(spark, no_rows).collect() == []
    assert neardup.keep_leaders(no_docs).columns == no_docs.columns


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies, one of them large, with edits around the threshold."""
    rng = random.Random(9)
    docs = []
    for size in (150, 3, 2, 2, 2, 1, 1, 12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + i, docs[i][1]) for i in range(40)]
    return docs


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies_against_all_pairs(spark, copies, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    frame = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    want = {d: b for (d, _), b in zip(copies, brute(copies))}
    for r in neardup.near_classes(frame).collect():
        assert (r["class_id"], r["n_links"], r["n_text_links"]) == want[r["doc_id"]]


def test_near_copies_in_blocks_some_of_them_empty(spark, copies, monkeypatch):
    """Long texts make more blocks than there are sets to fill them; no link counts twice."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 600)
    frame = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    want = {d: b for (d, _), b in zip(copies, brute(copies))}
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"])
           for r in neardup.near_classes(frame).collect()}
    assert got == want


@pytest.fixture(scope="module")
def templated():
    """Texts of one template, alike to 0.44, and three near copies of one of them."""
    rng = random.Random(4)
    template = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(i, " ".join(template + [f"o{rng.randrange(10**9)}" for _ in range(36)]))
            for i in range(600)]
    return docs + [(600 + i, f"{docs[300][1]} more{i}") for i in range(3)]


@pytest.mark.parametrize("cell", [1024, 8])
def test_texts_of_a_template_are_no_candidates(spark, templated, monkeypatch, cell):
    """Bands bring hundreds of them together; only the near copies are compared on full sets."""
    monkeypatch.setattr(neardup, "CELL_SETS", cell)
    compared, verify = [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda m, *a: compared.append(
        sorted({r["sid"] for r in m.select("sid").collect()})) or verify(m, *a))
    frame = spark.createDataFrame(templated, "doc_id long, text string").repartition(4)
    signed = neardup.signatures(frame.selectExpr("doc_id", "doc_id AS t", "text"), 40, 7)
    met = signed.selectExpr("explode(bands) AS b").groupBy("b").count().where("count > 1")
    assert met.selectExpr("sum(count * (count - 1) / 2)").first()[0] > 2_000
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.near_classes(frame).collect()}
    group = {300, 600, 601, 602}
    assert got == {d: (300, 3) if d in group else (d, 0) for d, _ in templated}
    assert [len(c) for c in compared] == [4]


@pytest.mark.parametrize("cell", [1024, 4])
def test_links_inside_a_bucket_whose_least_member_is_alone(spark, monkeypatch, cell):
    """Open members are linked with each other and with those that passed, across blocks."""
    monkeypatch.setattr(neardup, "CELL_SETS", cell)
    rng = np.random.default_rng(5)
    ends = rng.integers(0, 2**62, (4, 9))
    rows = []
    for sid in range(60):
        sketch = ends[sid % 4].copy()
        sketch[sid % 9] ^= 3 << (sid % 30)
        rows.append((sid, [7, 1000 + sid], [int(x) for x in sketch]))
    sets = spark.createDataFrame(rows, "sid long, bands array<long>, sketch array<long>")
    got = {r["node"]: r["root"] for r in neardup.connected(neardup.plausible(sets, 10)).collect()}
    assert got == {sid: sid % 4 for sid in range(60)}


def test_sketches_pass_pairs_at_the_threshold():
    most, rng = neardup.most_different(280), np.random.default_rng(2)
    differ = rng.binomial(280, 0.2 * 0.75, 400_000)
    assert (differ > most).mean() < 3e-5
    assert (rng.binomial(280, 0.56 * 0.75, 100_000) <= most).mean() < 1e-4


def test_one_document_of_each_class_stays(spark, odd, copies):
    kept = neardup.keep_leaders(spark.createDataFrame(copies, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({b[0] for b in brute(copies)})
    rows = neardup.keep_leaders(odd).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    # null ids stay where their class has no other; equal rows are one
    want = Counter()
    for (d, t), b in {(d, t): b for (d, t), b in zip(docs, brute(docs))}.items():
        want[d] += b[0] == d
    assert Counter(r["doc_id"] for r in rows) == +want


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in neardup.connected(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_bands_reach_the_recall():
    bands, rows = neardup.bands_and_rows()
    assert 1 - (1 - neardup.THRESHOLD ** rows) ** bands >= neardup.RECALL
    assert bands * rows <= neardup.MOST_HASHES


def test_overlaps(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (1, 20, 30, 5, 25)]
    got = neardup.overlaps(sets, np.arange(5), np.array([1, 3]))
    for i, a in enumerate(sets):
        for k, j in enumerate((1, 3)):
            assert i == j or got[i, k] == len(np.intersect1d(a, sets[j]))
