"""Documents with odd rows, shared by the tests of the training-data operators."""

import random

import pytest

#: Columns that operators might use themselves; they must not matter.
CLASHING = ["t", "h", "n", "k1", "shard", "slot", "size", "place", "bucket", "row", "gone", "_row",
            "sid", "kept", "x1", "grp", "n_words", "target", "uid", "score"]


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def odd_rows(seed=3):
    """Documents as tuples (doc_id, text, lang, source)."""
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        text = "\n".join(sentence(rng, rng.randint(12, 30)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}"))
    base = rows[5][1].split("\n")
    changed = base[0].split(" ")
    changed[4] = "changed"
    rows += [
        (100, None, "en", "s0"), (101, "", "en", "s1"), (102, " \t\n\r ", "en", None),
        (103, "one two", None, "s2"), (104, "one two", "en", "s2"), (105, sentence(rng, 20_000),
                                                                    "en", "s3"),
        (106, rows[5][1], "en", "s1"), (106, rows[5][1], "en", "s1"),
        (107, "\n".join([" ".join(changed), *base[1:]]), "en", "s2"),
        (None, rows[7][1], "en", "s0"), (None, None, None, None),
        (108, "\n".join(["the very same line of seven words"] * 9), "en", "s1"),
        (109, "Ünï çode \u00a0 \u2003 wörds 中文 한글 \U0001f600 " * 5, "de", "ß"),
        (110, "$$$ ### *** " * 30, "en", "s0"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with more columns whose names operators use inside."""
    rows = [(*r, *["x"] * len(CLASHING)) for r in odd_rows()]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(
        f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """Table folder with the odd documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def no_rows(spark, odd, tmp_path_factory):
    """Table folder with empty tables."""
    path = str(tmp_path_factory.mktemp("empty"))
    odd.where("false").write.parquet(f"{path}/documents.parquet")
    for name, schema in {
        "embeddings": "vec_id long, embedding array<float>, label int",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path
