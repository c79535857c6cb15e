"""NumPy kernels on whole Arrow batches of texts, shared by the text operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; as these bytes
never occur inside a multi-byte UTF-8 character, bytes and code points give the
same words. Batches are cut into slices of bounded bytes, never inside a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def bounded_batches(df: DataFrame, rows: int = 2000, size: int = 32 << 20) -> DataFrame:
    """df; sees to it that Arrow batches hold `rows` whole texts and about `size` bytes at most, which bounds what a worker has at once.

    Spark reads both limits when a plan runs, so they are lowered in the caller's
    session and stay so; limits that are lower already are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


class _Powers:
    """base**i and base**-i for i below n, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end]: equal runs, equal hashes, wherever they stand."""
    up, down = _POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLD + np.uint64(seed))


class Slice:
    """Some rows of a batch: their bytes, the words in them, and the row of each word."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.row = np.searchsorted(bounds, self.starts, "right") - 1
        #: word w of row r is at offsets[r] + w
        self.offsets = np.searchsorted(self.starts, bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word_hashes(self, lower: bool, seed: int = 0) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        return run_hash(byte_table(seed)[data], self.starts, self.ends)


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The batch in order, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        end = min(end, len(texts))
        yield Slice(k, flat[at[k] : at[end]], at[k : end + 1] - at[k])
        k = end


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of k consecutive words: its row and the index of its first word in the slice."""
    per = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), per)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + first[row]
    return row, start


def shingle_sets(piece: Slice, k: int, lower: bool = True, seed: int = 0) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles.

    A text of 1 to k-1 words has its whole word sequence as only shingle; one
    without words has none.
    """
    words, counts = piece.word_hashes(lower, seed), piece.counts()
    row, start = window_starts(counts, k)
    hashes = run_hash(words, start, start + k)
    cut = np.searchsorted(row, np.arange(piece.n + 1))
    out = []
    short = run_hash(words, piece.offsets[:-1], piece.offsets[1:])
    for r in range(piece.n):
        if counts[r] >= k:
            h = np.sort(hashes[cut[r] : cut[r + 1]])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(short[r : r + 1] if counts[r] else short[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bits of a fixed bitmap are 64 times this: 4 million bits, half a megabyte, whatever the input.
BITMAP_WORDS = 1 << 16


def fixed_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of all keys (one column of 64-bit hashes), or-ed on the executors; the driver gets BITMAP_WORDS rows at most.

    It may say yes to a key that was never added, the more so the fuller it is;
    it never says no to one that was.
    """
    key = keys.columns[0]
    word = F.pmod(F.shiftrightunsigned(key, 6), F.lit(BITMAP_WORDS)).cast("int").alias("word")
    rows = keys.select(word, F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return out


def has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return ((bitmap[((keys >> np.uint64(6)) % np.uint64(BITMAP_WORDS)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1)).astype(bool)
