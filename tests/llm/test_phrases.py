import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import phrases
from holdfast.llm.common import slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def brute_force(rows, least=10, share=50, top=2000, longest=3):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, found in counts.items():
        kept = []
        for p, a in found.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and n >= least and 100 * n >= share * a
                   and any(q[i:i + len(p)] == p for i in range(len(q))) for q, n in found.items()):
                continue
            score, _, l, r = min(
                (int(Fraction(1_000_000 * a * a, found[p[:k]] * found[p[k:]])), k, found[p[:k]],
                 found[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def odd_texts():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "New", "YORK", "über", "中文", " ", "x" * 40, "it's", "\x1f"]
    gaps = [" ", " ", " ", "\t", "  ", ".", "\n", ", ", "!?", "\x0b", "\x0c\r"]
    rows = [(rng.choice(["en", "de", "und", None]), "".join(
        rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randint(0, 90))))
        for _ in range(60)]
    shared = "the quick brown fox jumps over the lazy dog and then runs away from all of them " * 4
    rows += [("en", f"{rng.choice(vocabulary)} {shared}") for _ in range(9)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " .,\n "), ("en", "same " * 3000),
             ("de", "A B " * 500)]
    rows += [("en", "one row many times over")] * 15
    return rows


SCHEMA = "lang string, text string"
CLASHING = ["chunk", "phrase", "n", "a", "l", "r", "rank", "score", "part", "words", "longer"]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("every,least,share,top", [(8, 10, 50, 2000), (1, 3, 80, 7), (10**6, 2, 50, 50)])
def test_all_phrases(spark, monkeypatch, every, least, share, top):
    for name in ("PARSED_BYTES", "COUNTED_BYTES", "CHUNK_BYTES", "PHRASE_BYTES"):
        monkeypatch.setattr(phrases, name, 2000)
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA + "".join(
        f", `{c}` string" for c in CLASHING)).repartition(5)
    got = phrases.collocations(docs, least=least, share=share, top=top, every=every)
    assert rows_of(got) == brute_force(rows, least, share, top)


def test_longer_phrases(spark):
    rows = odd_texts()
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), longest=5)
    assert rows_of(got) == brute_force(rows, longest=5)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text("ab .\n", max_size=40), min_size=1, max_size=6),
       longest=st.integers(2, 4), every=st.sampled_from([1, 2, 3, 8]))
def test_chunks_overlap_and_cover(texts, longest, every):
    """Every run of words starts in exactly one chunk outside its overlap, and lies whole in it."""
    import pyarrow as pa
    want, got = Counter(), Counter()
    for i, t in enumerate(texts):
        for words in pieces_of(t):
            for k in range(1, longest + 1):
                want.update((i, tuple(words[j:j + k])) for j in range(len(words) - k + 1))
    for _, _, offsets, data in slices(pa.array(texts)):
        found, row, _ = phrases.chunks(offsets, data, longest, every)
        for chunk, i in zip(found.to_pylist(), row):
            words = chunk.split()
            own = len(words) if chunk.endswith("\n") else len(words) - longest + 1
            assert own > 0
            for k in range(1, longest + 1):
                got.update((i, tuple(words[j:j + k])) for j in range(own) if j + k <= len(words))
    assert got == want


def test_counts_beyond_64_bits(spark):
    big = 10**14
    counts = spark.createDataFrame(
        [("en", "a", 3 * big), ("en", "b", 2 * big + 1), ("en", "a b", big + 7)],
        "lang string, phrase string, n long")
    (row,) = phrases.scored(counts).collect()
    a, l, r = big + 7, 3 * big, 2 * big + 1
    assert tuple(row) == ("en", "a b", a, l, r, 1_000_000 * a * a // (l * r), None)


def test_registered_query_equals_sql(spark, sf):
    con = connect(sf)
    assert difference(phrases.op12_phrases(spark, sf), con, phrases.ORACLES["op12_phrases"]) is None


def test_sql_on_odd_texts():
    rows = odd_texts()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang TEXT, text TEXT)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(
        "SELECT lang, rank, phrase, a, l, r, n, score FROM "
        f"({phrases.ORACLES['op12_phrases']})").fetchall()) == brute_force(rows)


def test_no_rows(spark, no_rows):
    assert phrases.op12_phrases(spark, no_rows).collect() == []
