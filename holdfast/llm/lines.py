"""Operator 8. Line dedup by a deletion-neighbourhood join.

Two lines match when their words are equal, or when one word is replaced, added or removed. For
every line all variants with at most one word deleted are hashed: lines that differ in one word
share the variant without it, and a line that has one word more shares the shorter line itself.
Equal variants are brought together, the edit distance of the words is verified, and of matching
lines the earliest stays (least doc_id, then line number).

A line goes if any earlier line matches it, whether that line itself stays or not; so the result
needs no closure over chains. Equal lines are one line for the join. Per variant only the earliest
line is kept as partner, so a variant that a million lines share gives a million pairs, not their
square. Before variants are written, lines whose first and last halves no other line shares are
left out: one edit always leaves one half as it was, so no match is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import (
    _STEP_INVERSE, WordArrays, bitmap, has_bit, mix64, powers, quoted, slices, staged, table, text_of,
    whole_row,
)

#: Shorter lines are left alone.
MIN_WORDS = 5
#: Shorter lines match only when equal.
NEAR_WORDS = 10


class LineHashes:
    """Hashes of the word runs of lines, from running sums over the words of a batch."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end."""
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(value + (end - start).astype(np.uint64))

    def without(self, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end but for the one at ``gone``."""
        after = (self.sums[end] - self.sums[gone + 1]) * _STEP_INVERSE
        value = (self.sums[gone] - self.sums[start] + after) * self.down[start]
        return mix64(value + (end - start - 1).astype(np.uint64))


def _line_starts(w: WordArrays) -> tuple[np.ndarray, np.ndarray]:
    """First word of every line that has words, and the line number of every word."""
    feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
    line = feeds[w.start] - feeds[w.offsets[w.row]]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])
    return np.flatnonzero(new), line


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with words: doc_id, t (hash of the text), line, n, h, and hashes of the half lines."""
    names = ["doc_id", "t", "line", "n", "h", "a1", "a2", "z1", "z2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, offsets, data in slices(b.column(2)):
                w = WordArrays(offsets, data)
                if not len(w.start):
                    continue
                start, line = _line_starts(w)
                end = np.append(start[1:], len(line))
                n, hashes = end - start, LineHashes(w.hashes())
                halves = []
                for mark, left in ((1, True), (2, False)):
                    for p, none in ((n // 2, n < NEAR_WORDS),
                                    ((n - 1) // 2, (n < NEAR_WORDS) | (n % 2 == 1))):
                        key = hashes.run(start, start + p) if left else hashes.run(end - p, end)
                        halves.append(pa.array(mix64(key + np.uint64(mark)).view(np.int64),
                                               mask=none))
                row = pa.array(first + w.row[start])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(row), b.column(1).take(row),
                    pa.array(line[start].astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(hashes.run(start, end).view(np.int64)), *halves], names)

    return docs.mapInArrow(run, "doc_id long, t long, line int, n int, h long, a1 long, a2 long, "
                                "z1 long, z2 long")


def line_texts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Hash and words, joined by spaces, of all lines whose hash has its bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, offsets, data in slices(b.column(0)):
                w = WordArrays(offsets, data)
                if not len(w.start):
                    continue
                start, _ = _line_starts(w)
                end = np.append(start[1:], len(w.start))
                h = LineHashes(w.hashes()).run(start, end)
                own = np.flatnonzero((end - start >= NEAR_WORDS) & has_bit(bits, h))
                body = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[own].view(np.int64)),
                    pa.array([" ".join(_split(body[a:z].decode())) for a, z in zip(
                        w.start[start[own]].tolist(), w.end[end[own] - 1].tolist())], pa.string()),
                ], ["h", "words"])

    return docs.select("text").mapInArrow(run, "h long, words string")


def variants_of(texts: DataFrame) -> DataFrame:
    """All variants of lines with at most one word deleted; place -1 is the whole line."""
    names = ["v", "place", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, offsets, data in slices(b.column("words"), 1 << 18):
                w = WordArrays(offsets, data)
                n, hashes = w.counts(), LineHashes(w.hashes())
                start = np.cumsum(n) - n
                gone = np.arange(len(w.row))
                own = np.arange(len(n))
                row = pa.array(first + np.concatenate([w.row, own]))
                key = np.concatenate([
                    hashes.without(start[w.row], (start + n)[w.row], gone),
                    hashes.run(start, start + n)])
                place = np.concatenate([gone - start[w.row], np.full(len(n), -1)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)),
                    b.column("h").take(row)], names)

    return texts.select("h", "words").mapInArrow(run, "v long, place int, h long")


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are equal but for one word replaced, added or removed."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [one_edit(x.split(" "), y.split(" "))
                    for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))],
                                             ["h"])

    return pairs.select("h", "words", "other").mapInArrow(run, "h long")


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Hashes ``h`` of lines that an earlier line matches with one edit.

    ``first`` has the distinct lines: h, place of the first occurrence ``at``, and half hashes.
    """
    halves = first.select("h", F.explode(F.filter(F.array("a1", "a2", "z1", "z2"),
                                                  lambda x: x.isNotNull())).alias("key"))
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sharing = halves.join(shared, "key", "left_semi").select("h").distinct()
    chosen = first.select("h", "at").join(sharing, "h")
    chosen = staged(chosen.select("h", "at.doc_id", "at.line", "at.t"), "chosen-lines")
    texts = staged(line_texts(docs, bitmap(chosen, "h")).groupBy("h").agg(
        F.min("words").alias("words")).join(chosen, "h"), "line-texts")
    # most variants are met by one line only; those go before lines are compared
    every = variants_of(texts)
    met = every.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    places = texts.select("h", F.struct("doc_id", "line", "t", "h").alias("me"))
    variants = staged(every.join(met, "v", "left_semi").join(places, "h").select(
        "v", "place", "me"), "line-variants")
    deleted = variants.where("place >= 0")
    same_place = deleted.groupBy("v", "place").agg(
        F.min("me").alias("best"), F.count("*").alias("n")).where("n > 1")
    replaced = deleted.join(same_place, ["v", "place"]).where("me > best").select("me", "best")
    meeting = variants.groupBy("v").agg(
        F.min(F.when(F.col("place") < 0, F.col("me"))).alias("short"),
        F.min(F.when(F.col("place") >= 0, F.col("me"))).alias("long"),
    ).where("short IS NOT NULL AND long IS NOT NULL")
    removed = meeting.where("long < short").select(
        F.col("short").alias("me"), F.col("long").alias("best"))
    added = deleted.join(meeting.select("v", F.col("short").alias("best")), "v").where(
        "best < me").select("me", "best")
    pairs = replaced.unionByName(removed).unionByName(added).select(
        F.col("me.h").alias("h"), F.col("best.h").alias("other_h")).distinct()
    words = texts.select("h", "words")
    return _verified(pairs.join(words, "h").join(words.select(
        F.col("h").alias("other_h"), F.col("words").alias("other")), "other_h")).distinct()


def _split(line: str) -> list[str]:
    return [w for w in line.translate(_BLANK).split(" ") if w]


_BLANK = {c: 32 for c in range(9, 14)}


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without lines that an earlier line matches.

    All rows and columns stay; ``text`` is rewritten, and ``n_lines`` (lines with a word),
    ``n_copies`` and ``n_near`` (lines removed) are added, replacing columns of these names. Lines
    of fewer than ``MIN_WORDS`` words stay; lines of fewer than ``NEAR_WORDS`` match only when
    equal. A null text stays null. A null id comes before all others. Rows that agree in id and text
    are taken for one document and get the same result. An empty table gives no rows.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"),
                       F.xxhash64(text_of(docs[text])).alias("t"), docs[text].alias("text"))
    lines = staged(lines_of(rows).where(F.col("n") >= MIN_WORDS), "lines")
    place = F.struct("doc_id", "line", "t")
    first = staged(lines.groupBy("h").agg(
        F.min(place).alias("at"), *[F.first(c).alias(c) for c in ("a1", "a2", "z1", "z2")]),
        "first-lines")
    near = staged(near_lines(rows, first), "near-lines").withColumn("near", F.lit(True))
    known = first.select("h", "at").join(near, "h", "left")
    gone = lines.join(known, "h").select(
        "doc_id", "t", "line",
        F.struct(F.col("at.doc_id").alias("doc_id"), F.col("at.line").alias("line"),
                 F.col("at.t").alias("t")).eqNullSafe(place).alias("first"), "near",
    ).where("NOT first OR near").groupBy(
        F.col("doc_id").alias("g_doc"), F.col("t").alias("g_t")).agg(
        F.collect_set("line").alias("gone"),
        F.size(F.collect_set(F.when(F.col("first"), F.col("line")))).alias("near_n"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, numbers):
            if t is not None and g is not None and len(g):
                drop = set(g)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
            out.append(t)
        return pd.Series(out)

    gone = staged(gone, "gone-lines")
    bits = bitmap(gone, "g_t")

    @F.pandas_udf("boolean")
    def touched(t: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bits, t.to_numpy()))

    added = ["n_lines", "n_copies", "n_near"]
    columns = [c for c in docs.columns if c not in added]
    base = docs.select(whole_row([c for c in columns if c != text]).alias("_row"),
                       docs[key].cast("long").alias("_id"), docs[text].alias("_text"),
                       F.xxhash64(text_of(docs[text])).alias("_t")).withColumn("_hit", touched("_t"))
    # documents that lose no line are not shuffled
    joined = base.where("_hit").join(gone, (F.col("_t") == F.col("g_t"))
                                     & F.col("_id").eqNullSafe(F.col("g_doc")), "left")
    joined = joined.unionByName(base.where("NOT _hit"), allowMissingColumns=True)
    wordy = F.filter(F.split(text_of("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    near_n = F.coalesce("near_n", F.lit(0))
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.withColumns({
        "_n_lines": F.size(wordy).cast("long"), "_n_near": near_n.cast("long"),
        "_n_copies": (n_gone - near_n).cast("long"),
        "_kept": F.when(F.col("gone").isNull(), F.col("_text")).otherwise(without("_text", "gone")),
    }).select(*[F.col("_kept").alias(c) if c == text else F.col("_row")[c].alias(c)
                for c in columns], *[F.col(f"_{c}").alias(c) for c in added])


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The deduplicated documents; those that lost all their lines go. ``n_chars`` follows.

    Columns that are named like the counts of ``dedup_lines`` keep their values.
    """
    own = {c: f"own {c}" for c in ("n_lines", "n_copies", "n_near") if c in docs.columns}
    done = dedup_lines(docs.withColumnsRenamed(own)).where(
        "n_copies + n_near = 0 OR n_lines > n_copies + n_near").drop("n_lines", "n_copies", "n_near")
    done = done.withColumnsRenamed({new: c for c, new in own.items()})
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[quoted(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed as equal or near to earlier ones, digest of what stays."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_copies", "n_near",
                       F.md5(text_of("text")).alias("kept_md5"))


_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Documents without lines that match earlier ones; needs a table ``given`` of documents.
DEDUP_SQL = rf"""
l0 AS (
  SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS line, unnest(a) AS body
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM given)
), l1 AS (
  SELECT doc_id, line, body, {_SPLIT.format("body")} AS w FROM l0
), l2 AS (
  SELECT doc_id, line, body, w, len(w) AS n, array_to_string(w, ' ') AS k FROM l1
), firsts AS (
  SELECT k, any_value(w) AS w, min(n) AS n, min((doc_id, line)) AS pos
  FROM l2 WHERE n >= {MIN_WORDS} GROUP BY k
), half AS (
  SELECT k, w, n, pos, unnest(list_distinct([
    'a' || array_to_string(w[:n // 2], ' '), 'a' || array_to_string(w[:(n - 1) // 2], ' '),
    'z' || array_to_string(w[n - n // 2 + 1:], ' '),
    'z' || array_to_string(w[n - (n - 1) // 2 + 1:], ' ')])) AS key
  FROM firsts WHERE n >= {NEAR_WORDS}
), chosen AS (
  SELECT DISTINCT k, w, n, pos FROM half
  WHERE key IN (SELECT key FROM half GROUP BY key HAVING count(*) > 1)
), cut AS (
  SELECT k, pos, i, array_to_string(w[:i] || w[i + 2:], ' ') AS v
  FROM (SELECT k, w, pos, unnest(range(n)) AS i FROM chosen)
), best AS (
  SELECT v, i, min(pos) AS pos FROM cut GROUP BY v, i
), near AS (
  SELECT cut.k FROM cut JOIN best USING (v, i) WHERE best.pos < cut.pos
  UNION SELECT cut.k FROM cut JOIN chosen ON chosen.k = cut.v WHERE chosen.pos < cut.pos
  UNION SELECT chosen.k FROM cut JOIN chosen ON chosen.k = cut.v WHERE cut.pos < chosen.pos
), judged AS (
  SELECT l2.doc_id, l2.line, l2.body, l2.n,
    coalesce(f.pos <> (l2.doc_id, l2.line), false) AS copy, near.k IS NOT NULL AS near
  FROM l2 LEFT JOIN firsts f ON f.k = l2.k AND l2.n >= {MIN_WORDS}
  LEFT JOIN near ON near.k = l2.k AND l2.n >= {MIN_WORDS}
), cleaned AS (
  SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (copy) AS n_copies,
    count(*) FILTER (near AND NOT copy) AS n_near,
    count(*) FILTER (n > 0 AND NOT copy AND NOT near) AS n_left,
    coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT copy AND NOT near), '') AS body
  FROM judged GROUP BY doc_id
)"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": f"""WITH given AS (SELECT doc_id, text FROM documents), {DEDUP_SQL}
SELECT doc_id, n_lines, n_copies, n_near, md5(body) AS kept_md5 FROM cleaned"""}
