"""Parts that several operators share: table reads, staging, and word arrays for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import staged

__all__ = ["table", "staged", "quoted", "whole_row", "words", "text_of", "slices", "WordArrays", "mix64", "distinct",
           "bitmap", "has_bit", "WHITE", "LOWER"]

#: ASCII white space, the separators of words: space and 0x09 to 0x0D.
WHITE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, whatever the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(columns: list[str]) -> Column:
    """Columns as one struct."""
    return F.struct(*[quoted(c) for c in columns])


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True
#: Byte translation that lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one example of each, and the value's number per place."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


#: Bits of a bitmap of hashes.
BITMAP_BITS = 24


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the low ends of hashes, 2 MB whatever the number of rows.

    Rows whose bit is not set have no partner, so they need not be shuffled to a join; the join
    itself stays exact, also when most bits are set.
    """
    low = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for word, value in hashes.select(low.alias("low")).groupBy(
            F.shiftright("low", 6).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))"))).collect():
        bits[word] = np.uint64(value & (2**64 - 1))
    return bits


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    low = hashes.view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))
            & np.uint64(1)).astype(bool)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash step and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(max(n, SLICE_BYTES), _STEP), np.full(max(n, SLICE_BYTES), _STEP_INVERSE)
        up[0] = down[0] = 1
        _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[
        tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most ``limit`` bytes: first row, end row, offsets, bytes.

    Nulls count as empty texts; a longer text comes alone.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, offsets[at:end + 1] - offsets[at], raw[offsets[at]:offsets[end]]
        at = end


class WordArrays:
    """Words of a run of texts as arrays: start and end byte, row of the text, 64-bit hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.offsets, self.data = offsets, LOWER[data] if lower else data
        n = len(data)
        self.n_texts = len(offsets) - 1
        if not n:
            self.start = self.end = self.row = np.zeros(0, np.int64)
            return
        white = _IS_WHITE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, white[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, white[1:]
        self.start = np.flatnonzero(~white & (before | first[:-1]))
        self.end = np.flatnonzero(~white & (after | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_texts)

    def hashes(self) -> np.ndarray:
        """Hash of every word; depends on its bytes alone."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data))
        total = np.zeros(len(up) + 1, np.uint64)
        np.cumsum(up * _BYTE_CODE[self.data], out=total[1:])
        found = (total[self.end] - total[self.start]) * down[self.start]
        return mix64(found + (self.end - self.start).astype(np.uint64))
