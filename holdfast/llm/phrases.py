"""Operator 12. Collocations by prefix-free parsing.

Texts are cut into pieces and pieces into chunks: a chunk ends where the hash of the latest words
triggers, and the next one starts with these same words, so neighbours overlap by one word less than
the longest phrase. Where a chunk ends depends on the words around alone; copies and shared passages
give the same chunks. Distinct chunks form a dictionary with their frequencies. Phrases are
counted inside distinct chunks, times the frequency. Every phrase lies whole in a chunk, and one
that lies in the overlap belongs to the later chunk, so it is counted once.

Chunks and phrases travel as compressed cells, one for each bucket of hashes and run of texts, and
the equal strings of a bucket are added up by the task that reads it. The number of buckets grows with the
texts, so a bucket's size is bounded, and a frequent phrase is one entry a cell. Infrequent phrases
never become rows.

Counts are exact, per language. A candidate is a phrase of two words or more with a count of at least
``least``. All cuts of a candidate into two phrases are scored by count^2 / (left * right), in whole
millionths and in decimal arithmetic; the worst cut counts. A candidate inside a longer one that makes up
``share`` per cent of its occurrences or more is dropped.

A null text is empty, a null language is ``und``. Empty tables give no rows. Only the language and the
text are read, so other columns do not matter. Repeated rows count as often as they occur. A task
works on runs of texts of 2 MB, or one longer text; a piece without a trigger is one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import LOWER, WordArrays, mix64, slices, staged, table

#: Most words of a phrase.
LONGEST = 3
#: One of so many windows of words ends a chunk.
EVERY = 8
LEAST, SHARE, TOP = 10, 50, 2000
#: Candidates of a language are ranked in so many parts first.
PARTS = 64
#: Bytes of texts that are parsed together, and of distinct chunks whose phrases are counted together.
PARSED_BYTES, COUNTED_BYTES = 2 << 20, 2 << 20
#: Bytes of texts for each bucket of chunks and each bucket of phrases.
CHUNK_BYTES, PHRASE_BYTES = 16 << 20, 4 << 20

_GAP, _STOP = 0x20, 0x0A
#: Bytes as the parse sees them: A-Z in lower case, one byte for gaps and one for ends of pieces.
SEEN = LOWER.copy()
SEEN[0x09] = _GAP
SEEN[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _STOP
_ODD = np.uint64(0xD6E8FEB86659FD93)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, at the place of its first one; shorter runs at the end."""
    out = mix64(hashes + np.uint64(size))
    for j in range(1, min(size, len(hashes))):
        out[:-j] = mix64(out[:-j] * _ODD + hashes[j:])
    return out


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """Runs of bytes as strings."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    where = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(
        len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[where]))


def chunks(offsets: np.ndarray, data: np.ndarray, longest: int = LONGEST, every: int = EVERY) -> tuple[
        pa.StringArray, np.ndarray, np.ndarray]:
    """Chunks of a run of texts, the row of each, and a hash.

    Words are joined by one space; the last chunk of a piece ends with a line end.
    """
    w = WordArrays(offsets, SEEN[data])
    if not len(w.start):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, overlap = len(w.start), longest - 1
    stops = np.cumsum(w.data == _STOP)
    closes = np.ones(n, bool)  # the word is the last of its piece
    closes[:-1] = (w.row[1:] != w.row[:-1]) | (stops[w.start[1:]] != stops[w.start[:-1]])
    opens = np.r_[True, closes[:-1]]
    place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    # a window that triggers ends at a word and starts the next chunk
    hashes = w.hashes()
    triggers = np.zeros(n, bool)
    triggers[overlap - 1:] = (windows(hashes, overlap) % np.uint64(every) == 0)[
        :n - overlap + 1]
    triggers &= (place >= overlap) & ~closes
    first = np.sort(np.r_[np.flatnonzero(opens), np.flatnonzero(triggers) - overlap + 1])
    last = np.sort(np.r_[np.flatnonzero(closes), np.flatnonzero(triggers)])
    # the words with one byte behind each
    size = w.end - w.start + 1
    at = np.cumsum(size) - size
    words = np.repeat(w.start - at, size) + np.arange(size.sum())
    even = np.append(w.data, np.uint8(0))[words]
    even[at + size - 1] = np.where(closes, _STOP, _GAP)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(hashes), out=total[1:])
    return (strings(even, at[first], at[last] + size[last] - ~closes[last]), w.row[first],
            mix64(total[last + 1] - total[first]))


def packed(texts: pa.Array, n: np.ndarray) -> bytes:
    """Strings and their numbers as one compressed cell."""
    batch = pa.RecordBatch.from_arrays([texts, pa.array(n)], ["text", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema,
                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def dealt(lang: str, texts: pa.Array, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: lang, bucket, cell."""
    order = np.argsort(bucket, kind="stable")
    buckets, first = np.unique(bucket[order], return_index=True)
    texts, n = texts.take(pa.array(order)), n[order]
    ends = np.append(first[1:], len(order))
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(buckets), pa.string()), pa.array(buckets.astype(np.int64)),
        pa.array([packed(texts[a:z], n[a:z]) for a, z in zip(first, ends)], pa.binary())],
        ["lang", "bucket", "cell"])


DEALT = "lang string, bucket long, cell binary"


def merged(cells: DataFrame, then: Callable[[str, pa.Array, np.ndarray], Iterator[pa.RecordBatch]],
           schema: str) -> DataFrame:
    """Adds up equal strings of each bucket and gives them to ``then``, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i) for i in range(3))))
        for (lang, _), group in groupby(rows, key=lambda r: (r[0].as_py(), r[1].as_py())):
            whole = pa.concat_tables(
                pa.ipc.open_stream(r[2].as_buffer()).read_all() for r in group)
            whole = whole.group_by("text", use_threads=False).aggregate([("n", "sum")])
            yield from then(lang, whole["text"].combine_chunks(), whole["n_sum"].to_numpy())

    return cells.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(
        run, schema)


def dictionary_cells(docs: DataFrame, lang: str, text: str, longest: int, every: int,
                     buckets: int) -> DataFrame:
    """Chunks with their frequencies, as cells of buckets of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for first, last, offsets, data in slices(b.column(1), PARSED_BYTES):
                found, row, hashes = chunks(offsets, data, longest, every)
                own = codes[first:last][row]
                for code in np.unique(own):
                    at = np.flatnonzero(own == code)
                    texts = found.take(pa.array(at)).dictionary_encode()
                    place = texts.indices.to_numpy(zero_copy_only=False)
                    bucket = np.zeros(len(texts.dictionary), np.uint64)
                    bucket[place] = hashes[at] % np.uint64(buckets)
                    yield dealt(langs.dictionary[code].as_py(), texts.dictionary,
                                np.bincount(place), bucket)

    return docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"),
                       docs[text].alias("text")).mapInArrow(run, DEALT)


def ranked(texts: pa.StringArray) -> tuple[np.ndarray, int]:
    """Rank of each string among the distinct ones, and their number."""
    found = texts.dictionary_encode()
    rank = np.empty(len(found.dictionary), np.int64)
    rank[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[found.indices.to_numpy()], len(rank)


def runs(w: WordArrays, own: np.ndarray, ends: np.ndarray, weight: np.ndarray, longest: int
         ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: the place of one example of each phrase, and occurrences.

    Phrases start at the words ``own`` and lie before ``ends`` (of every word). They are told apart by
    ranks of their words, so the counts are exact; they come in order.
    """
    if not len(own):
        return
    code, n_words = ranked(strings(w.data, w.start, w.end))
    key, at = code[own], own
    for size in range(1, longest + 1):
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        yield size, at[order[new]], np.add.reduceat(weight[at[order]], np.flatnonzero(new))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        more = at + size < ends[at]
        if not more.any():
            return
        at = at[more]
        key = rank[more] * n_words + code[at + size]


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST,
                  least: int = 1, every: int = EVERY) -> DataFrame:
    """Phrases of up to ``longest`` words that occur ``least`` times or more: lang, phrase, n.

    The empty phrase has the number of all words of the language.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    overlap, buckets = longest - 1, max(1, -(-size // PHRASE_BYTES))

    def count(lang: str, texts: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = 0
        for first, last, offsets, data in slices(texts, COUNTED_BYTES):
            w = WordArrays(offsets, data)
            ends = np.cumsum(w.counts())[w.row]  # behind the last word of the chunk
            whole = (data[offsets[1:] - 1] == _STOP)[w.row]
            own = np.flatnonzero(whole | (np.arange(len(ends)) < ends - overlap))
            weight = n[first:last][w.row]
            words += int(weight[own].sum())
            hashes, found = w.hashes(), []
            for k, at, sums in runs(w, own, ends, weight, longest):
                found.append((strings(w.data, w.start[at], w.end[at + k - 1]), sums,
                              windows(hashes, k)[at] % np.uint64(buckets)))
            yield dealt(lang, pa.concat_arrays([f[0] for f in found]), *(
                np.concatenate([f[i] for f in found]) for i in (1, 2)))
        yield dealt(lang, pa.array([""]), np.array([words]), np.zeros(1, np.uint64))

    def total(lang: str, texts: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = pa.array((n >= least) | pc.equal(texts, "").to_numpy(zero_copy_only=False))
        texts, n = texts.filter(kept), pa.array(n).filter(kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), texts, n], ["lang", "phrase", "n"])

    found = dictionary_cells(docs, lang, text, longest, every, max(1, -(-size // CHUNK_BYTES)))
    return merged(merged(found, count, DEALT), total, "lang string, phrase string, n long")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with their worst cut: lang, phrase, a, l, r, score, longer.

    ``counts`` has every phrase that occurs as often as a candidate; ``longer`` is the highest count
    of a longer candidate around this one.
    """
    cands = counts.withColumn("words", F.split("phrase", " ")).withColumn(
        "size", F.size("words")).where("size > 1")
    cuts = cands.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("""
        transform(sequence(1, size - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') AS first,
            array_join(slice(words, k + 1, size), ' ') AS rest))""")).alias("cut")).select(
        "lang", "phrase", "a", "cut.k", "cut.first", "cut.rest")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)),
                         ["lang", part])
    a, l_, r = (F.col(c).cast("decimal(18,0)") for c in "alr")
    cuts = cuts.withColumn("x", F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).withColumn(
        "y", l_ * r).withColumn("score", F.expr("x div y"))
    around = cands.where("size > 2").select("lang", F.col("n").alias("longer"), F.explode(F.expr("""
        flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1),
            s -> array_join(slice(words, s, k), ' '))))""")).alias("phrase"))
    best = F.struct("score", "k", "l", "r")
    none = F.lit(None)
    rows = cuts.select("lang", "phrase", "a", best.alias("cut"), none.cast("long").alias("longer"))
    more = around.select("lang", "phrase", none.cast("long").alias("a"),
                         none.cast(rows.schema["cut"].dataType).alias("cut"), "longer")
    return rows.unionByName(more).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "longer")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST,
                 least: int = LEAST, share: int = SHARE, top: int = TOP,
                 every: int = EVERY) -> DataFrame:
    """The first ``top`` candidates of each language, by score, count and phrase.

    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    counts = staged(phrase_counts(docs, lang, text, longest, least, every), "phrase-counts")
    phrases = counts.where(F.col("phrase") != "")
    kept = scored(phrases).where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    parted = Window.partitionBy("lang", "part").orderBy(*order)
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(parted)).where(
        F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where(F.col("phrase") == "").select("lang", F.col("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, per language."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {
    "op12_phrases": r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id,
    list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), placed AS (
  SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces
), runs AS (
  SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3
  FROM placed WINDOW piece AS (PARTITION BY id ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, array_to_string(words, ' ') AS phrase, words, count(*) AS f FROM (
    SELECT lang, [w1] AS words FROM runs UNION ALL
    SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL UNION ALL
    SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL)
  GROUP BY lang, words HAVING count(*) >= 10
), cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, k,
    (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT lang, phrase, f AS a, unnest(range(1, len(words))) AS k,
      array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest
    FROM counts WHERE len(words) > 1) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = c.first
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM counts WHERE len(words) = 3
    UNION ALL
    SELECT lang, array_to_string(words[2:3], ' '), f FROM counts WHERE len(words) = 3)
  GROUP BY ALL
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank,
  w.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
FROM worst w JOIN totals t ON t.lang = w.lang
LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 50 * a
QUALIFY rank <= 2000
""",
}
