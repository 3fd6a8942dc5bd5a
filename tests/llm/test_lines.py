import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, difference
from holdfast.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """Result by comparing every line with all earlier ones. ``docs``: (doc_id, text), distinct."""
    out, earlier = {}, []
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    gone = {}
    for d, t in order:
        for i, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if len(w) < lines.MIN_WORDS:
                continue
            copy = any(w == e for e in earlier)
            near = any(len(w) >= lines.NEAR_WORDS <= len(e) and w != e and lines.one_edit(w, e)
                       for e in earlier)
            # a line goes as near if the first of its copies has an earlier match
            first = next((j for j, e in enumerate(earlier) if e == w), len(earlier))
            near = any(len(w) >= lines.NEAR_WORDS <= len(e) and w != e and lines.one_edit(w, e)
                       for e in earlier[:first])
            if copy or near:
                gone[d, t, i] = "copy" if copy else "near"
            earlier.append(w)
    for d, t in order:
        body = (t or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(body) if (d, t, i) not in gone)
        kinds = [gone.get((d, t, i)) for i in range(len(body))]
        out[d, t] = (sum(bool(WORD.search(x)) for x in body), kinds.count("copy"),
                     kinds.count("near"), kept)
    return out


def test_registered_query(spark, sf):
    assert difference(lines.op8_line_dedup(spark, sf), connect(sf),
                      lines.ORACLES["op8_line_dedup"]) is None


def test_odd_documents(spark, odd):
    docs = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = brute(docs)
    done = lines.dedup_lines(odd)
    assert set(odd.columns) < set(done.columns)
    before = {}
    for d, t in docs:
        before.setdefault(d, set()).add(t)
    rows = done.collect()
    assert len(rows) == odd.count()
    for r in rows:
        options = [(want[r["doc_id"], t], t) for t in before[r["doc_id"]]]
        assert any((r["n_lines"], r["n_copies"], r["n_near"]) == w[:3] and (
            r["text"] == w[3] if t is not None else r["text"] is None) for w, t in options)


def test_edits_in_all_places(spark):
    rng = random.Random(4)
    docs, base = [], []
    for i in range(60):
        w = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(9, 16))]
        base.append(w)
        docs.append((i, " ".join(w)))
    for i in range(60, 240):
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = "zz"
            elif kind == 1:
                w.insert(at, rng.choice(["zz", w[at]]))
            else:
                del w[at]
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    for r in lines.dedup_lines(frame).collect():
        w = want[r["doc_id"], docs[r["doc_id"]][1]]
        assert (r["n_lines"], r["n_copies"], r["n_near"], r["text"]) == w


def test_no_rows(spark, no_rows):
    assert lines.op8_line_dedup(spark, no_rows).collect() == []


def test_stage_drops_emptied_documents(spark):
    line = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame(
        [(1, line, 5), (2, line, 5), (3, f"{line}\nmore", 5), (4, "", 0), (5, None, None)],
        "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(frame).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert (got[3]["text"], got[3]["n_chars"]) == ("more", 4)


words = st.lists(st.sampled_from("abc"), max_size=6)


@settings(max_examples=300, deadline=None)
@given(a=words, b=words)
def test_one_edit(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i][j] = i + j if not i or not j else min(
                table[i - 1][j] + 1, table[i][j - 1] + 1,
                table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert lines.one_edit(a, b) == (table[-1][-1] <= 1)


@pytest.mark.parametrize("text", ["a b c d", "a  b\tc d", " a b c d "])
def test_hashes_depend_on_words_alone(text):
    import pyarrow as pa

    from holdfast.llm.common import WordArrays, slices
    import numpy as np
    (_, _, offsets, data), = slices(pa.array([text, "a b x c d"]))
    w = WordArrays(offsets, data)
    h = lines.LineHashes(w.hashes())
    whole = h.run(np.array([0]), np.array([4]))
    assert whole == h.without(np.array([4]), np.array([9]), np.array([6]))
    assert hashlib.md5(b"").hexdigest()
