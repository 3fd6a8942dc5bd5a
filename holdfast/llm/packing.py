"""Operator 3. Cost-balanced packing of token sequences.

A task reads its documents, turns them into ids, and packs runs of them. A piece of ``n`` tokens
costs ``n + quadratic * n * n``: the linear layers, and attention inside the piece. Pieces are taken
in descending length; each goes to the sequence with the lowest cost so far that has room for it.
A run gets as many sequences as its tokens need. Documents above the sequence length are cut
before, and a piece that fits nowhere is cut at the largest gap, so a run leaves less than one
sequence of padding.

There is no shuffle and no group: a run ends at ``run_tokens``, so memory does not depend on the
table. The result depends on the rows and their layout in files only; a task that is run again
gives the same pieces and ids.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm.common import LOWER, WordArrays, distinct, slices, table

LENGTH = 2048
#: Cost of attention against that of the linear layers: 1 / (6 * width) for a width of 4096.
QUADRATIC = 1 / (6 * 4096)
RUN_TOKENS = 1 << 20
#: Distinct word parts whose ids a task remembers.
REMEMBERED = 1 << 19
#: Words per text when distinct words are turned into ids.
JOINED = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_SEQUENCES = 40  # bits of a sequence id below the number of its task


class Encoder:
    """Ids of texts, with a memory for the ids of word parts.

    White space always parts tokens here, so a text's ids are those of its words in turn. Trailing
    stops and commas after a letter are parts of their own. Equal parts are encoded once.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.zeros(size + 1, bool)
        for text, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = text.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Places of the parts in a new order, their numbers of ids, and all ids in that order."""
        # a part of letters alone is one word to the tokenizer, and ends with an id that says so
        plain = [i for i, p in enumerate(parts) if p.isalpha() and (
            p.isascii() or unicodedata.normalize("NFC", p).lower().isalpha())]
        alone = sorted(set(range(len(parts))).difference(plain))
        order, lengths, ids = [], [], []
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(
                [" ".join([parts[i] for i in g]) for g in groups], add_special_tokens=False)):
            own = np.asarray(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends_word[own]) + 1
            if len(cut) != len(g) or cut[-1] != len(own):
                alone.extend(g)
                continue
            order.extend(g)
            lengths.append(np.diff(cut, prepend=0))
            ids.append(own)
        for i, e in zip(alone, self.tokenizer.encode_batch_fast(
                [parts[i] for i in alone], add_special_tokens=False)):
            order.append(i)
            lengths.append([len(e.ids)])
            ids.append(np.asarray(e.ids, np.uint32))
        return order, np.concatenate(lengths).astype(np.int64), np.concatenate(ids)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts: number for each text, and all ids in turn."""
        own = data if b"<|" in data.tobytes() else LOWER[data]  # marks of the tokenizer keep case
        w = WordArrays(offsets, own)
        if not len(w.start):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint32)
        stem = w.end.copy()
        for _ in range(3):
            more = (stem - 1 > w.start) & _STOP[own[stem - 1]]
            stem -= more
        last, lead = own[stem - 1], own[np.maximum(stem - 2, 0)]
        accented = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) \
            & (stem - 2 >= w.start)
        stem = np.where(_LETTER[last] | accented, stem, w.end)
        tail = stem < w.end
        first = np.cumsum(1 + tail) - (1 + tail)
        n = len(w.start) + int(tail.sum())
        start, end, row = (np.empty(n, np.int64) for _ in range(3))
        start[first], end[first], row[first] = w.start, stem, w.row
        after = first[tail] + 1
        start[after], end[after], row[after] = stem[tail], w.end[tail], w.row[tail]
        w.start, w.end = start, end
        known, example, which = distinct(w.hashes())
        if len(self.known) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.known, known)
        if len(self.known):
            new = self.known[np.minimum(spot, len(self.known) - 1)] != known
        else:
            new = np.ones(len(known), bool)
        if new.any():
            body = own.tobytes()
            places, length, ids = self.encode(
                [body[a:z].decode() for a, z in zip(start[example[new]].tolist(),
                                                    end[example[new]].tolist())])
            at = len(self.pool) + np.cumsum(length) - length
            every = np.concatenate([self.known, known[new][places]])
            order = np.argsort(every)
            self.known = every[order]
            self.at = np.concatenate([self.at, at])[order]
            self.length = np.concatenate([self.length, length])[order]
            self.pool = np.concatenate([self.pool, ids])
            spot = np.searchsorted(self.known, known)
        at, length = self.at[spot][which], self.length[spot][which]
        begin = np.cumsum(length) - length
        ids = self.pool[np.repeat(at - begin, length) + np.arange(length.sum())]
        return np.bincount(row, length, len(offsets) - 1).astype(np.int64), ids


def assign(lengths: np.ndarray, capacity: int = LENGTH, quadratic: float = QUADRATIC) -> list:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    pieces, waiting = [], []
    n = 0
    for doc, length in enumerate(lengths):
        for at in range(0, int(length) - capacity + 1, capacity):
            pieces.append((doc, at, capacity, n, 0))
            n += 1
        rest = int(length) % capacity
        if rest:
            waiting.append((rest, doc, int(length) - rest))
    waiting.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(x[0] for x in waiting) // capacity)
    cost, used = np.zeros(count), np.zeros(count, np.int64)

    def put(doc: int, at: int, length: int, s: int) -> None:
        pieces.append((doc, at, length, n + s, int(used[s])))
        used[s] += length
        cost[s] += length + quadratic * length * length

    for length, doc, at in waiting:
        while length:
            free = used + length <= capacity
            if free.any():
                put(doc, at, length, int(np.argmin(np.where(free, cost, np.inf))))
                break
            s = int(np.argmin(used))
            part = capacity - int(used[s])
            put(doc, at, part, s)
            at, length = at + part, length - part
    return pieces


def pack(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id",
         capacity: int = LENGTH, quadratic: float = QUADRATIC, end_id: int = 1,
         run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row per piece, with its ids and its place in a sequence.

    A null text is empty; it gives a piece with the end id alone. Rows need no distinct keys, other
    columns are not read. An empty table gives no rows. ``vocabulary`` is the path of the tokenizer
    file on the executors; without one it is the installed ``word_bpe_49k.json``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder, number = Encoder(path), TaskContext.get().partitionId() << _SEQUENCES
        keys: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            length = np.concatenate(counts)
            all_ids, begin = np.concatenate(ids), np.cumsum(length) - length
            rows = assign(length, capacity, quadratic)
            doc, at, n, seq, offset = (np.array(x, np.int64) for x in zip(*rows))
            part = [all_ids[begin[d] + a:begin[d] + a + m] for d, a, m in zip(doc, at, n)]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                pa.array([keys[d] for d in doc], pa.int64()), pa.array(at), pa.array(n),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in part], pa.int64()),
                pa.array(length[doc]), pa.array(seq + number), pa.array(offset),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(
                    np.concatenate(part).astype(np.int32))),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                "ids"])
            number += int(seq.max()) + 1
            keys.clear(), counts.clear(), ids.clear()
            return out

        waiting = 0
        for b in batches:
            names = b.column(0).to_pylist()
            for first, last, offsets, data in slices(b.column(1)):
                n, flat = encoder(offsets, data)
                whole = np.full(len(flat) + len(n), end_id, np.uint32)
                row = np.repeat(np.arange(len(n)), n)
                whole[np.arange(len(flat)) + row] = flat
                keys.extend(names[first:last])
                counts.append(n + 1)
                ids.append(whole)
                waiting += len(whole)
                if waiting >= run_tokens:
                    yield packed()
                    waiting = 0
        if keys:
            yield packed()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long, ids array<int>")


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op3_cost_packing": op3_cost_packing}
ORACLES: dict[str, str] = {}
