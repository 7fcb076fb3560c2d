"""Substring dedup over word windows with a compressed FM-index per shard.

Shards come from `repeats`, which routes segments of documents by content; copies of a segment are one row
with a multiplicity. A shard's index is the Burrows-Wheeler transform of its segments'
words in a wavelet matrix of packed bits with block ranks. All segments are streamed against it by
backward search, many in lock step: the right end of a segment is extended to the left while the
match occurs twice, and where it fails the remaining windows are searched from their own right ends.
These matching statistics, cut at the window, are all that is asked for: a window repeats if its
match reaches `WINDOW` words while the suffixes of the interval count two or more. Words are compared as bytes.

Defined results: null and empty texts have no words; texts shorter than a window are kept whole but
for white space, which becomes single spaces; repeated rows repeat each other, so both lose their
windows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .repeats import remove_repeats

WINDOW, K = 35, 18


class WaveletMatrix:
    """Rank over a sequence of small integers; one packed bit vector with 64-bit block ranks per level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.n, self.levels = len(values), max(1, int(sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the boundary `at` lands among the symbols of the last level."""
        for i, (bits, ranks, zeros) in enumerate(zip(self.bits, self.ranks, self.zeros, strict=True)):
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            at = np.where(up, zeros + ones, at - ones)
        return at


class FmIndex:
    """FM-index of a sequence of symbols from 1; 0 separates segments. Suffixes are sorted by at
    least `depth` symbols, which is exact for patterns up to that length. A suffix counts `times`."""

    def __init__(self, text: np.ndarray, depth: int, times: np.ndarray):
        rank, span = text.astype(np.int64), 1
        while True:
            nxt = np.zeros_like(rank)
            nxt[:-span] = rank[span:]
            pair = rank * (int(rank.max()) + 1) + nxt
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[False], pair[order][1:] != pair[order][:-1]])
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            span *= 2
            if span >= depth or rank[order[-1]] == len(text) - 1:
                break
            if span >= len(text):
                break
        sigma = int(text.max()) + 1
        self.n = len(text)
        self.upto = np.concatenate([[0], np.cumsum(times[order])])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        every = np.arange(sigma)
        self.shift = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1] - self.wavelet.place(every, np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The intervals of symbol + pattern, from those of the patterns."""
        both = self.wavelet.place(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.shift[symbol], 2)
        return both[: len(lo)], both[len(lo) :]

    def leftmost(self, text: np.ndarray, right: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For right ends (inclusive), the smallest start >= floor from which the span occurs twice,
        or right + 1 if not even its last symbol does."""
        at = right + 1
        active = np.arange(len(right))
        lo, hi = np.zeros(len(right), np.int64), np.full(len(right), self.n, np.int64)
        while len(active):
            active = active[at[active] > floor[active]]
            a, b = self.extend(text[at[active] - 1], lo[active], hi[active])
            twice = self.upto[b] - self.upto[a] >= 2
            active = active[twice]
            lo[active], hi[active] = a[twice], b[twice]
            at[active] -= 1
        return at


def repeated_windows(shard: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of segments, and masks of their windows that occur twice in the shard; a segment counts `m` times."""
    said = b" ".join(x["text"] for x in shard).split(b" ")
    symbol = pa.array(said, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    n = np.array([x["n"] for x in shard])
    count = n + WINDOW - 1
    # one separator before each segment
    seg = np.repeat(np.arange(len(shard)), count)
    text = np.zeros(len(symbol) + len(shard) + 1, np.int64)
    text[np.arange(len(symbol)) + seg + 1] = symbol + 1
    first = np.cumsum(count + 1) - count
    times = np.ones(len(text), np.int64)
    times[first[0] :] = np.append(np.repeat(np.array([x["m"] for x in shard]), count + 1), 1)[: len(text) - first[0]]
    index = FmIndex(text, int(count.max()) + 1, times)
    # the longest repeated tail of each segment
    last = first + n - 1
    tail = index.leftmost(text, last + WINDOW - 1, first)
    masks = [np.arange(size) >= t - b for size, t, b in zip(n.tolist(), tail.tolist(), first.tolist(), strict=True)]
    at, end = first.copy(), np.minimum(tail, last + 1) - 1  # windows at..end are still open
    while True:
        live = np.flatnonzero(at <= end)
        if not len(live):
            break
        got = index.leftmost(text, at[live] + WINDOW - 1, at[live])
        hit = got == at[live]
        for j in live[hit].tolist():
            masks[j][at[j] - first[j]] = True
        # a window that fails at position got - 1 takes all windows that start there or before along
        at[live] = np.where(hit, at[live] + 1, got)
    for i, mask in enumerate(masks):
        if mask.any():
            yield i, mask


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, n_spans, kept (text)."""
    out = remove_repeats(spark, docs, id_col, text_col, True, WINDOW, K, repeated_windows)
    return out.select("id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
