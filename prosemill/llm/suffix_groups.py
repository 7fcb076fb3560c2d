"""Suffix-array dedup of long byte strings by linear grouping construction.

Shards come from `repeats`. Within a shard the segments are cut into blocks of `BLOCK` bytes on a grid
through their anchors, so equal windows have equal blocks; a block is one symbol. The suffix array of
these symbols is built in two phases:

* groups: suffixes are grouped by their Lyndon prefixes. Groups are processed in descending order;
  each member looks up the previous position in a lower group (a previous-smaller pointer, found by
  following pointers of positions that are done), and those positions move up to a new group right
  above the rest of theirs, ordered by how many members they lead.
* order: scanning the array from its smallest suffix, each suffix places the ones before it
  along the pointers, at the next free place of their groups.

No names are assigned again and nothing recurses. Runs of neighbours in the array that share all whole
blocks of a window are then split by the bytes at both edges. Blocks and edges are compared as bytes, so the
decision is exact to the byte; copies of a segment are one row with a multiplicity, which counts.

Defined results: null and empty texts have no bytes; repeated rows repeat each other, so both lose
their windows; what is kept may end inside a UTF-8 character and is binary; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, spread
from .common import table
from .repeats import remove_repeats

WINDOW, K = 400, 200
BLOCK = 16  # divides WINDOW


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a sequence of integers; a missing symbol is smaller than any other."""
    n = len(text)
    if n == 0:
        return []
    # groups by first symbol, linked from the highest downwards; the end is a group of its own
    members: list[list[int]] = [[n]]
    by_symbol: dict[int, int] = {}
    for symbol in sorted(set(text)):
        by_symbol[symbol] = len(members)
        members.append([])
    group = [0] * (n + 1)
    for i, symbol in enumerate(text):
        g = by_symbol[symbol]
        group[i] = g
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = bytearray(n + 1)
    before = [-1] * (n + 1)
    order: list[int] = []  # groups, highest first
    g = len(members) - 1
    while g != -1:
        members[g] = own = [i for i in members[g] if group[i] == g]
        order.append(g)
        for i in own:
            done[i] = 1
        led: dict[int, list[int]] = {}  # by number of members they lead: positions in lower groups
        last, count = -1, 0
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                if j == last:
                    count += 1
                else:
                    if last >= 0:
                        led.setdefault(count, []).append(last)
                    last, count = j, 1
        if last >= 0:
            led.setdefault(count, []).append(last)
        for c in sorted(led, reverse=True):  # few: different numbers sum to the size of the group at most
            made: dict[int, int] = {}
            for p in led[c]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new  # something is always above a lower group
                group[p] = new
                members[new].append(p)
        g = below[g]
    # places of the groups, lowest first
    place = [0] * len(members)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    out = [-1] * (n + 1)
    out[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for r in range(n + 1):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            j = before[j]
    return out[1:]


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal for equal rows only."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sixteen(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 16 bytes at each place, as two numbers."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    return tuple(eight[at + d].copy().view(U64)[:, 0] for d in (0, 8))


def repeated_windows(shard: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of segments, and masks of their windows that occur twice in the shard; a segment counts `m` times."""
    n = np.array([x["n"] for x in shard], np.int64)
    times = np.array([x["m"] for x in shard], np.int64)
    data = np.frombuffer(b"".join(x["text"] for x in shard) + bytes(BLOCK), np.uint8)
    size = n + WINDOW - 1
    first = np.cumsum(size) - size
    # whole blocks on the grid through the anchor
    grid = np.array([x["anchor"] for x in shard], np.int64) % BLOCK
    whole = (size - grid) // BLOCK
    owner = np.repeat(np.arange(len(shard)), whole)
    start = spread(np.zeros(len(shard), np.int64), whole) * BLOCK + np.repeat(first + grid, whole)
    symbol = _ranks(*_sixteen(data, start))
    # symbols from 1, a separator after each segment
    place = np.arange(len(symbol)) + owner
    text = np.zeros(len(symbol) + len(shard), np.int64)
    text[place] = symbol + 1
    source = np.full(len(text), -1, np.int64)
    source[place] = np.arange(len(symbol))
    order = np.array(suffix_array(text.tolist()), np.int64)
    # neighbours that share the whole blocks inside a window
    inside = WINDOW // BLOCK - 1
    long = source[order] >= 0
    block = source[order[long]]
    enough = block + inside <= np.repeat(np.cumsum(whole), whole)[block]
    block = block[enough]
    if not len(block):
        return
    same = np.ones(len(block) - 1, bool)
    for d in range(inside):
        same &= symbol[block[1:] + d] == symbol[block[:-1] + d]
    run = np.concatenate([[0], np.cumsum(~same)])
    crowd = np.bincount(run, weights=times[owner[block]])[run] > 1
    block, run = block[crowd], run[crowd]
    # windows whose first whole block it is: they start up to BLOCK - 1 bytes before it
    begin = start[block]
    relative = (begin - first[owner[block]])[:, None] - np.arange(BLOCK)[None, :]
    i, p = np.nonzero((relative >= 0) & (relative < n[owner[block]][:, None]))
    if not len(i):
        return
    # the BLOCK bytes of the window outside the shared blocks: p before them, the rest behind
    front = _sixteen(data, begin[i] - p)
    back = _sixteen(data, begin[i] + inside * BLOCK)
    edge = []
    for half in (0, 8):
        kept = np.clip(p - half, 0, 8).astype(U64) * U64(8)
        mask = np.where(kept >= 64, ~U64(0), (U64(1) << np.minimum(kept, 63)) - U64(1))
        edge.append(front[half // 8] & mask)
    for half in (0, 8):
        kept = np.clip(BLOCK - p - half, 0, 8).astype(U64) * U64(8)
        mask = np.where(kept >= 64, ~U64(0), (U64(1) << np.minimum(kept, 63)) - U64(1))
        edge.append(back[half // 8] & mask)
    kind = _ranks(run[i], p, *edge)
    who, where = owner[block][i], relative[i, p]
    twice = np.bincount(kind, weights=times[who])[kind] > 1
    who, where = who[twice], where[twice]
    by = np.argsort(who, kind="stable")
    who, where = who[by], where[by]
    cut = np.flatnonzero(np.diff(who)) + 1
    for s, w in zip(np.split(who, cut), np.split(where, cut), strict=True):
        if len(s):
            mask = np.zeros(n[s[0]], bool)
            mask[w] = True
            yield int(s[0]), mask


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept (binary)."""
    out = remove_repeats(spark, docs, id_col, text_col, False, WINDOW, K, repeated_windows)
    return out.withColumnRenamed("n_units", "n_bytes")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
