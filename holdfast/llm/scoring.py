"""Operator 2. Language-model scores by prediction by partial matching.

Training counts, over all whole training texts, which byte follows each context of up to ``ORDER``
bytes. Scoring walks from the longest context down: a byte seen ``n`` times after the context has
probability ``(2n - 1) / 2 total``, else the escape ``distinct / 2 total`` is paid (method D) and the
next shorter context is asked, without the bytes the longer one has seen (symbol exclusion). Below the
empty context all bytes not excluded are equally likely. So the code length of a text is that of a
proper distribution over texts.

Texts are lower-cased words (A-Z only) joined by one space, with an end mark. Contexts are kept with
the latest byte first, so that all shorter contexts are prefixes. Every counted context takes part:
the distinct pairs of a context and a byte are partitioned by the latest ``TOP`` + 1 bytes, so that a
run of them holds the whole trie below; only the depths up to ``TOP``, which the alphabet bounds, are
sent to the tasks. That gives the value of each pair that any text holds, in a written table. The
``CAPACITY`` most frequent pairs are looked up in the task that scores a text, the others are joined
by a shuffle; both ways give the same score.

The base score needs the count of every word. The most frequent words, at most ``HEAD``, are looked
up in the task; the others are joined with the counted vocabulary by a shuffle. So no frequent word
is a shuffle key, and the vocabulary is never sent anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import WordArrays, distinct, mix64, slices, staged, table

ORDER = 5
#: Pairs of a context and a byte whose values are sent to every task; the others are joined.
CAPACITY = 1 << 21
#: Longest contexts whose counts are sent to every task.
TOP = 2
#: Pairs that are valued at a time, or all those of one context of ``TOP`` + 1 bytes.
VALUED = 1 << 20
HEAD = 1 << 18
#: Bytes that no UTF-8 text holds: before a text, and after it.
START, END = 0xFE, 0xFF
SYMBOLS = 256
#: Distinct keys a task gathers before it hands them on, and bytes it works on at a time.
GATHERED = 1 << 20
SLICE = 1 << 20


def symbols(w: WordArrays) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text joined by spaces and ended by ``END``: bytes, and where texts start."""
    n = w.n_texts
    size = np.bincount(w.row, w.end - w.start, n).astype(np.int64)
    count = w.counts()
    total = size + np.maximum(count, 1)
    begin = np.cumsum(total) - total
    out = np.full(int(total.sum()), 0x20, np.uint8)
    out[begin + total - 1] = END
    length = w.end - w.start
    before = np.cumsum(length + 1) - (length + 1)
    empty = np.cumsum(count == 0)
    to = np.repeat(before + empty[w.row] - w.start, length)
    source = np.repeat(w.start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[source + to] = w.data[source]
    return out, begin


def contexts(out: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """Key of every position: its context, latest byte first, then the byte itself."""
    place = np.arange(len(out)) - np.repeat(begin, np.diff(begin, append=len(out)))
    key = np.zeros(len(out), np.int64)
    for j in range(1, order + 1):
        key <<= 8
        key[:j] |= START
        key[j:] |= np.where(place[j:] >= j, out[:len(out) - j], START)
    return key << 8 | out


class Gathered:
    """Counts of keys, merged when there are many."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, _, number = distinct(np.concatenate(self.keys))
        counts = np.bincount(number, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.waiting = [keys], [counts], len(keys)
        return keys, counts


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Partial counts: of words (kind 0, key is the hash) and of contexts with a byte (kind 1).

    ``docs`` has the columns ``text`` and ``held_out``; words of held-out texts are not counted, and
    their contexts are kind 2. A task hands on its counts at its end, or when it holds many, so its
    memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Gathered(), Gathered(), Gathered()]

        def given(kind: int) -> pa.RecordBatch:
            keys, counts = held[kind].merged()
            held[kind] = Gathered()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                 pa.array(counts)], ["kind", "key", "n"])

        for b in batches:
            out_of = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, offsets, data in slices(b.column(0), SLICE):
                w = WordArrays(offsets, data, lower=True)
                out, begin = symbols(w)
                away = out_of[first:last]
                far = np.repeat(away, np.diff(begin, append=len(out)))
                grams = contexts(out, begin, order)
                for kind, keys in enumerate((w.hashes().view(np.int64)[~away[w.row]],
                                             grams[~far], grams[far])):
                    values, _, number = distinct(keys)
                    held[kind].add(values, np.bincount(number, minlength=len(values)))
                    if held[kind].waiting > 2 * GATHERED:
                        held[kind].merged()
                    if held[kind].waiting > GATHERED:
                        yield given(kind)
        for kind in (0, 1, 2):
            yield given(kind)

    return docs.mapInArrow(run, "kind int, key long, n long")


def least_count(counts: DataFrame, capacity: int) -> int:
    """Least count that at most ``capacity`` rows reach; from a histogram of the counts."""
    steps = counts.groupBy(F.when(F.col("n") < 4096, F.col("n")).otherwise(
        F.pow(2.0, F.floor(F.log2("n") * 16) / 16).cast("long")).alias("n")).count()
    room, found = capacity, 2**62  # more than any count: nothing fits
    for n, rows in sorted(((r[0], r[1]) for r in steps.collect()), reverse=True):
        if rows > room:
            return found
        room, found = room - rows, n
    return 1


class Trie:
    """Counts by context, one sorted table for each length of context.

    With ``top`` the tables go on below those of another trie.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], top: Trie | None = None):
        self.grams, self.n, self.contexts, self.total, self.seen, self.shorter = (
            list(getattr(top, part, ())) for part in
            ("grams", "n", "contexts", "total", "seen", "shorter"))
        self.order = len(self.grams) + len(tables) - 1
        for j, (keys, n) in enumerate(tables, len(self.grams)):
            by = np.argsort(keys)
            keys, n = keys[by], n[by].astype(np.float64)
            context, first = np.unique(keys >> 8, return_index=True)
            self.grams.append(keys)
            self.n.append(n)
            self.contexts.append(context)
            self.seen.append(np.diff(first, append=len(keys)).astype(np.float64))
            self.total.append(np.add.reduceat(n, first) if len(n) else np.zeros(0))
            if j:  # what the bytes seen after a context count after the next shorter one
                lower = (keys >> 16) << 8 | keys & 0xFF
                at, hit = _find(self.grams[j - 1], lower)
                of = np.where(hit, self.n[j - 1][at], 0.0) if len(at) else np.zeros(0)
                self.shorter.append(np.add.reduceat(of, first) if len(n) else np.zeros(0))
            else:
                self.shorter.append(np.zeros(len(context)))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of the byte after the context, for keys of the full order."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        no_total, no_seen = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(self.order, -1, -1):
            context = keys[left] >> 8 >> 8 * (self.order - j)
            c, known = _find(self.contexts[j], context)
            g, hit = _find(self.grams[j], context << 8 | keys[left] & 0xFF)
            if len(self.contexts[j]):
                seen = np.where(known, self.seen[j][c] - no_seen[left], 0.0)
                whole = 2 * np.where(known, self.total[j][c] - no_total[left], 0.0)
                usable = seen > 0
                hit &= usable
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = np.where(hit, 2 * self.n[j][g] - 1, seen) / whole
                    out[left] += np.where(usable, np.log10(part), 0.0)
                no_total[left] = np.where(known, self.shorter[j][c], no_total[left])
                no_seen[left] = np.where(known, self.seen[j][c], no_seen[left])
                left = left[~hit]
        out[left] -= np.log10(np.maximum(SYMBOLS - no_seen[left], 1.0))
        return out


def _find(table_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the value is there."""
    if not len(table_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table_, wanted), len(table_) - 1)
    return at, table_[at] == wanted


def _shorter(keys: np.ndarray, n: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts with contexts that are ``by`` bytes shorter."""
    keys, _, number = distinct(keys >> 8 * by + 8 << 8 | keys & 0xFF)
    return keys, np.bincount(number, n, len(keys)).astype(np.int64)


def values(grams: DataFrame, order: int = ORDER, top: int = TOP) -> DataFrame:
    """Log10 probability ``value`` of every key of the full order, and its uses ``m``.

    ``grams`` has key, ``n`` (count in the training texts, may be 0) and ``m``.
    """
    top = min(top, order)
    short = F.shiftleft(F.shiftright("key", 8 * (order - top) + 8), 8).bitwiseOR(
        F.col("key").bitwiseAND(F.lit(255)))
    rows = grams.where("n > 0").groupBy(short.alias("key")).agg(F.sum("n").alias("n")).toArrow()
    last = rows["key"].to_numpy(), rows["n"].to_numpy()
    head = grams.sparkSession.sparkContext.broadcast(
        vars(Trie([*(_shorter(*last, top - j) for j in range(top)), last])))
    shift = 8 * max(order - top - 1, 0) + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = Trie([])
        above.__dict__.update(head.value)
        held: list[list[np.ndarray]] = []
        waiting = 0

        def given(keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            own, count = keys[n > 0], n[n > 0]
            trie = Trie([_shorter(own, count, order - j) for j in range(top + 1, order + 1)], above)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(m), pa.array(trie.log10(keys))], ["key", "m", "value"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            waiting += b.num_rows
            if waiting >= VALUED and held[0][0][0] >> shift != held[-1][0][-1] >> shift:
                cells = [np.concatenate(c) for c in zip(*held)]
                # the last context may go on in the next batch
                cut = np.searchsorted(cells[0] >> shift, cells[0][-1] >> shift)
                yield given(*(c[:cut] for c in cells))
                held = [[c[cut:] for c in cells]]
                waiting = len(held[0][0])
        if held:
            yield given(*(np.concatenate(c) for c in zip(*held)))

    return (grams.select("key", "n", "m").repartition(F.shiftright("key", shift))
            .sortWithinPartitions("key").mapInArrow(run, "key long, m long, value double"))


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
          order: int = ORDER, capacity: int = CAPACITY, head: int = HEAD) -> DataFrame:
    """Log10 probability of every text, learned from the rows where ``held_out`` is not true.

    A null text is empty and still has its end. Rows need no distinct keys, a null key is kept.
    Other columns are not read. Without training rows every byte is equally likely and no word is
    known. An empty table gives no rows.
    """
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = F.col("kind")
    counts = staged(gather(docs.select("text", "held_out"), order)
                    .groupBy((kind > 0).alias("gram"), "key").agg(
                        F.sum(F.when(kind < 2, F.col("n")).otherwise(0)).alias("n"),
                        F.sum("n").alias("m")), "scoring-counts")
    words = counts.where("NOT gram").select("key", "n")
    n_words, n_distinct, texts = (int(x or 0) for x in (
        *words.agg(F.sum("n"), F.count("*")).first(),
        docs.where("NOT held_out").count()))
    train_tokens, vocabulary = n_words + texts, n_distinct + (texts > 0)
    floor = least_count(words, head)
    valued = staged(values(counts.where("gram"), order), "byte-values")
    least = least_count(valued.select(F.col("m").alias("n")), capacity)

    def sent(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
        found = rows.select("key", column).toArrow()
        by = np.argsort(found["key"].to_numpy())
        return found["key"].to_numpy()[by], found[column].to_numpy()[by]

    model = docs.sparkSession.sparkContext.broadcast((
        *sent(valued.where(F.col("m") >= least), "value"),
        *sent(words.where(F.col("n") >= floor), "n")))
    unit = float(np.log10(train_tokens + vocabulary + 1))
    end_value = float(np.log10(texts + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pair_worth, common, common_n = model.value
        worth = np.log10(common_n + 1.0)
        uid = TaskContext.get().partitionId() << 40
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "gram",
                 "key", "n"]
        for b in batches:
            ids, held = b.column(0), b.column(2)
            for first, last, offsets, data in slices(b.column(1), SLICE):
                w = WordArrays(offsets, data, lower=True)
                m = w.n_texts
                out, begin = symbols(w)
                grams, _, place = distinct(contexts(out, begin, order))
                at, hit = _find(pairs, grams)
                value = np.add.reduceat((np.where(hit, pair_worth[at], 0.0) if len(pairs)
                                         else np.zeros(len(grams)))[place], begin)
                left = np.flatnonzero(~hit[place])
                of = np.searchsorted(begin, left, "right") - 1
                keys, _, number = distinct(w.hashes().view(np.int64))
                at, hit = _find(common, keys)
                known = hit[number]
                base = np.bincount(w.row, (np.where(hit, worth[at], 0.0) if len(worth)
                                           else np.zeros(len(keys)))[number], m)
                own = np.arange(uid, uid + m)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own), ids.slice(first, m), held.slice(first, m),
                    pa.array(w.counts() + 1),
                    pa.array(np.bincount(w.row, known, m).astype(np.int64) + (texts > 0)),
                    pa.array(base + end_value), pa.array(value),
                    pa.array(np.zeros(m, bool)), pa.array(mix64(own).view(np.int64)),
                    pa.array(np.zeros(m, np.int64)),
                ], names)
                rare = np.flatnonzero(~known)
                for gram, row, found, which in ((False, w.row[rare], keys, number[rare]),
                                                (True, of, grams, place[left])):
                    pair, example, which_pair = distinct(row * max(1, len(found)) + which)
                    k = len(pair)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own[row[example]]), pa.nulls(k, pa.int64()),
                        pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                        pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                        pa.array(np.full(k, gram)), pa.array(found[which[example]]),
                        pa.array(np.bincount(which_pair, minlength=k)),
                    ], names)
                uid += m

    rows = docs.mapInArrow(
        run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
             "score double, gram boolean, key long, n long")
    rest = words.where(F.col("n") < floor).select(
        F.lit(False).alias("gram"), "key", F.log10(F.col("n") + 1.0).alias("value")).unionByName(
        valued.where(F.col("m") < least).select(F.lit(True).alias("gram"), "key", "value"))
    more = F.col("n") * F.coalesce("value", F.lit(0.0))
    return rows.join(rest, ["gram", "key"], "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("value").isNotNull() & ~F.col("gram"), F.col("n"))
                                  .otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(F.col("gram"), 0.0).otherwise(more))).alias("worth"),
        (F.sum("score") + F.sum(F.when(F.col("gram"), more).otherwise(0.0))).alias("score"),
    ).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long")
        .alias("train_tokens"), (F.col("worth") - F.col("n_tokens") * unit).alias("base_score"),
        "score")


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; held out are those whose checksum of the id leaves 2 modulo 7."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


QUERIES = {"op2_ppm_scores": op2_ppm_scores}
ORACLES: dict[str, str] = {}
