import re

import corpus_pipeline
from holdfast.llm import lines, mixing, neardup, packing, quality

from .test_lines import brute as brute_lines
from .test_mixing import filled
from .test_neardup import brute as brute_classes
from .test_packing import check as check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert corpus_pipeline.keep_good is quality.keep_good
    assert corpus_pipeline.drop_repeated_lines is lines.drop_repeated_lines
    assert corpus_pipeline.keep_leaders is neardup.keep_leaders
    assert corpus_pipeline.mixed_documents is mixing.mixed_documents
    assert corpus_pipeline.pack is packing.pack


def test_each_stage_against_brute_force(spark, sf):
    """Every stage's rows, from what the stage before it has kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    verdicts = {r["doc_id"] for r in quality.judge_quality(docs).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, sf).cache()
    assert good.columns == columns
    assert {r["doc_id"] for r in good.collect()} == verdicts
    before = {r["doc_id"]: r for r in docs.collect()}
    assert all(r == before[r["doc_id"]] for r in good.collect())

    clean = stages["line_dedup"](spark, good, sf).cache()
    assert clean.columns == columns
    want = brute_lines([(r["doc_id"], r["text"]) for r in good.collect()])
    kept = {d: w[3] for (d, _), w in want.items() if w[0] > w[1] + w[2] or w[1] + w[2] == 0}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    single = stages["near_duplicates"](spark, clean, sf).cache()
    assert single.columns == columns
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(
        {c for c, _, _ in brute_classes(rows)})

    mixed = stages["mixing"](spark, single, sf).cache()
    assert mixed.columns == columns
    sizes, words, texts = {}, {}, {}
    for r in single.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"]))
        texts[r["doc_id"]] = r["text"]
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= set(WORD.findall(texts[r["doc_id"]]))
    for s, target in filled(sizes).items():
        assert abs(words.get(s, 0) - target) <= 1

    packed = stages["packing"](spark, mixed, sf).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()])


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and rows[0]["ids"] and sum(len(r["ids"]) for r in rows) == sum(
        r["length"] for r in rows)


def test_no_documents(spark, no_rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_odd_documents_pass_through(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
