import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from holdfast.llm import packing
from holdfast.llm.common import table

FILE = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs):
    tokenizer = Tokenizer.from_file(FILE)
    want = defaultdict(int)
    whole = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        whole.append((d, ids))
        want[d, len(ids)] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for d, ids in whole:
        own = pieces[d, len(ids)]
        assert sum(r["length"] for r in own) == want[d, len(ids)] * len(ids)
        for r in own:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            same = [x for x in whole if x[0] == d and len(x[1]) == len(ids)]
            assert any(r["ids_crc32"] == zlib.crc32(np.array(
                x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for _, x in same)
            assert len(part) == r["length"]
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    return sum(len(i) for _, i in whole), len(sequences)


def test_registered_query(spark, sf):
    docs = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    tokens, sequences = check(packing.op3_cost_packing(spark, sf).collect(), docs)
    assert sequences <= tokens / packing.LENGTH + 1


def test_odd_documents(spark, folder, odd):
    docs = [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    check(packing.op3_cost_packing(spark, folder).collect(), docs)


def test_no_rows(spark, no_rows):
    assert packing.op3_cost_packing(spark, no_rows).collect() == []


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(FILE)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(
    st.text(max_size=40),
    st.text("aAéÉİßŒ.,'$! \n\t<|endoftx>0123\u00a0\u0301", max_size=40)), max_size=5))
def test_ids_equal_those_of_whole_texts(encoder, texts):
    import pyarrow as pa

    from holdfast.llm.common import slices
    got = []
    for _, _, offsets, data in slices(pa.array(texts, pa.string())):
        n, ids = encoder(offsets, data)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    test_ids_equal_those_of_whole_texts.hypothesis.inner_test(
        encoder, [f"word{'abcdefgh'[i % 8] * i}." for i in range(40)] * 2)


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 5000), min_size=1, max_size=60))
def test_assignment(lengths):
    rows = packing.assign(np.array(lengths))
    assert sum(r[2] for r in rows) == sum(lengths)
    used = defaultdict(int)
    for _, _, n, s, _ in rows:
        used[s] += n
    assert max(used.values()) <= packing.LENGTH
    rest = sum(n % packing.LENGTH for n in lengths)
    assert len(used) == sum(n // packing.LENGTH for n in lengths) + -(-rest // packing.LENGTH)


def test_costs_are_balanced():
    """Pieces of few lengths: costs differ less than under first fit."""
    lengths = np.array([1024] * 20 + [256] * 160)
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths, quadratic=1e-3):
        cost[s] += n + 1e-3 * n * n
    first_fit = [2 * (1024 + 1e-3 * 1024**2)] * 10 + [8 * (256 + 1e-3 * 256**2)] * 20
    assert max(cost.values()) < max(first_fit)
    assert max(cost.values()) - min(cost.values()) < max(first_fit) - min(first_fit)
