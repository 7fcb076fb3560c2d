"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

All kernels work on the concatenated bytes of a block of documents, so no Python loop runs per
word or per character. Blocks are cut at `BLOCK` bytes (a longer document makes a block of its own),
which bounds the memory of a worker whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: word separators of the contracts, [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, for span_hash()."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """span_hash() of all runs of k values."""
    pre, n = prefix(values), len(values) - k + 1
    raw = pre[k:] - pre[:n]
    raw *= _power(_INV, n)
    raw += U64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mix(raw)


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal spans wherever they stand."""
    raw = (pre[end] - pre[start]) * _power(_INV, len(pre))[start]
    raw += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(raw)


def blocks(column: pa.Array, limit: int = BLOCK):
    """(first row, end row, bytes, offsets) of consecutive runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Starts and ends of the words (maximal runs of bytes not in `gap`, cut at documents) and the
    index of each document's first word, one more entry than documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~gap[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    full = first <= last
    begins[first[full]] = solid[first[full]]
    ends[last[full]] = solid[last[full]]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words with one space after each, and their new starts and ends."""
    size = ends - starts
    end = np.cumsum(size + 1) - 1
    flat = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    place = np.ones(len(flat), bool)
    place[end] = False
    flat[place] = data[~SPACE[data]]
    return flat, end - size, end


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix(data.astype(U64) + U64(1)), starts, ends)


#: bits of a packed value that hold the position; a run of so many positions is worked on at once
_PLACE = 22


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value of each window h[i:i+w], by its upper bits, the leftmost of equal ones.

    A value's lower `_PLACE` bits are replaced by its position, so one minimum finds both; the choice in a
    window depends on its own values only, wherever it stands.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, step = U64((1 << _PLACE) - 1), (1 << _PLACE) - w
    out = np.empty(n, np.int64)
    for lo in range(0, n, step):
        part = h[lo : lo + step + w - 1]
        v = (part & ~low) | np.arange(len(part), dtype=U64)
        span = 1
        while span < w:
            by = min(span, w - span)
            v = np.minimum(v[:-by], v[by:])
            span += by
        out[lo : lo + step] = (v & low).astype(np.int64) + lo
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start .. start+count-1, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    first = np.cumsum(c) - c
    out[0] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Boolean mask of the positions inside any [start, start+length)."""
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, size), -1)
    return np.cumsum(delta[:-1]) > 0


def anchored(h: np.ndarray, cuts: np.ndarray, window: int, k: int):
    """Segments of the windows (of `window` values) of each document whose smallest k-gram hash is
    the same one: arrays of (anchor key, first window start, number of windows, offset of the anchor).

    `h` holds one hash per value; `cuts` the first value of each document and the end. Equal windows
    have the same anchor at the same offset, so all their occurrences meet under one key.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, U64), none, none, none
    grams = gram_hashes(h, k)
    at = sliding_argmin(grams, window - k + 1)
    fits = np.maximum(np.diff(cuts) - window + 1, 0)
    starts = spread(cuts[:-1], fits)
    if not len(starts):
        return np.zeros(0, U64), none, none, none
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s0 = starts[first]
    return grams[at[first]], s0, count, at[first] - s0
