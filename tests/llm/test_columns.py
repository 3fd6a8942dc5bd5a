"""Stages keep further columns, whatever these are called."""

import pytest

from holdfast.llm.lines import drop_repeated_lines
from holdfast.llm.mixing import mixed_documents
from holdfast.llm.neardup import keep_leaders
from holdfast.llm.quality import keep_good

NAMES = ["a.b", "text.x", "tick`ed", "with space", "n_copies", "n_near", "n_lines", "_row x"]


@pytest.mark.parametrize("stage", [keep_good, drop_repeated_lines, keep_leaders, mixed_documents])
def test_columns_of_any_name(spark, stage):
    rows = [(i, f"document {i} holds some words that no other one of them has, like w{i} and v{i} or x{i}",
             "en", f"s{i % 2}", i, *[f"{n} {i}" for n in NAMES]) for i in range(30)]
    rows.append((99, None, None, None, None, *[None] * len(NAMES)))
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(
        "`" + n.replace("`", "``") + "` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    done = stage(docs)
    assert done.columns == docs.columns
    kept = done.collect()
    assert kept
    for r in kept:
        if r["doc_id"] != 99:
            assert list(r)[5:] == [f"{n} {r['doc_id']}" for n in NAMES]
