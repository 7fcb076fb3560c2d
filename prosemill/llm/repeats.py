"""Routing of repeated windows to shards, shared by both operators that remove repeated spans.

A window is `window` consecutive units (words or bytes) of one document. It is keyed by its anchor, the
leftmost smallest hash of `k` consecutive units in it; equal windows have equal anchors at equal
offsets, so all occurrences of a window meet under one key. Windows of a document that share an
anchor form one segment. Then:

1. count segments per key; keys that occur once hold no repeated window and end here;
2. emit the segments of the other keys; a task sends the text of a segment once;
3. group equal segments by their bytes into one row with a multiplicity (map-side first, so a group of
   copies or a common passage is one row a task whatever its size);
4. a key with over `HOT` different segments is split by the place of the anchor in the window: windows whose anchor
   lies in the same quarter of the possible offsets share more text before and behind it, and that longer shared
   text is their new key; quarters that are still hot are split again, down to whole windows, which no longer differ;
5. keys go to shards whole; each shard builds its index and decides which windows of its segments occur
   twice, multiplicities counted;
6. the decisions are joined back to the segments and documents.

Hashes only route: segments are one if their bytes are equal, and indexes compare texts. Segments are named by
128-bit BLAKE2 digests of their bytes; two texts of one name end the job. Every table that is read twice is
written; filters that tasks hold are bounded in size, and what they let through by mistake only costs work.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, anchored, blocks, mix, single_spaced, word_hashes, words
from .common import KeyFilter, Scratch, heavy_left_join

#: units of text that a shard's index holds, but for a key that has more by itself
SHARD_UNITS = 1 << 18
#: different segments of a key that go to one shard, and the parts that a key with more is split into
HOT, PARTS = 256, 4

_BYTE = mix(np.arange(256, dtype=U64) + U64(77))
_RUNS = "array<struct<a:int,b:int>>"
_SHARD = "key long, seg binary, text binary, n int, anchor int, low int, high int, m long"


def units(data: np.ndarray, offsets: np.ndarray, by_word: bool):
    """Start and end byte of each unit, and the first unit of each document and the end."""
    if by_word:
        return words(data, offsets)
    at = np.arange(len(data))
    return at, at + 1, offsets


def _segments(data: np.ndarray, offsets: np.ndarray, by_word: bool, window: int, k: int):
    """Key, first window, windows and anchor's offset of each segment; bytes with single spaces, unit starts, ends, cuts."""
    starts, ends, cuts = units(data, offsets, by_word)
    h = word_hashes(data, starts, ends) if by_word else _BYTE[data]
    if by_word:
        data, starts, ends = single_spaced(data, starts, ends)
    return *anchored(h, cuts, window, k), data, starts, ends, cuts


def _name(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _split(x: dict, by_word: bool, window: int) -> Iterator[dict]:
    """The parts of a segment under the new keys, `PARTS` at most."""
    low, high = x["low"], x["high"]
    text = x["text"]
    if by_word:
        end = [i for i, c in enumerate(text) if c == 0x20] + [len(text)]
        cut = lambda a, b: text[end[a - 1] + 1 if a else 0 : end[b - 1]]
    else:
        cut = lambda a, b: text[a:b]
    anchor, n = x["anchor"], x["n"]
    each = -(-(high - low + 1) // PARTS)
    for lo in range(low, high + 1, each):
        hi = min(lo + each - 1, high)
        # windows start from `anchor` - hi to `anchor` - lo; all share the units from the last start to the first end
        first, last = max(0, anchor - hi), min(n - 1, anchor - lo)
        if first <= last:
            part = cut(first, last + window)
            shared = cut(anchor - lo, anchor - hi + window)
            key = hashlib.blake2b(struct.pack("<ii", lo, hi) + shared, digest_size=8).digest()
            yield {"parent": x["seg"], "off": first, "key": int.from_bytes(key, "little", signed=True), "seg": _name(struct.pack("<ii", lo, hi) + part), "text": part, "n": last - first + 1, "anchor": anchor - first, "low": lo, "high": hi, "m": x["m"]}


def _decided(spark: SparkSession, scratch: Scratch, segments: DataFrame, level: int, by_word: bool, window: int, index: Callable) -> DataFrame:
    """seg, m, runs of windows that occur twice, of different segments (_SHARD)."""
    crowded = segments.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > HOT).select("key")
    hot = KeyFilter(spark, crowded) if crowded.limit(1).count() else None

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(~hot.has(batch.column(0).to_numpy()) | (batch.column(5).to_numpy() >= batch.column(6).to_numpy()))
            yield batch.take(pa.array(keep))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(hot.has(batch.column(0).to_numpy()) & (batch.column(5).to_numpy() < batch.column(6).to_numpy()))
            for lo in range(0, len(some), 500):
                rows = [y for x in batch.take(pa.array(some[lo : lo + 500])).to_pylist() for y in _split(x, by_word, window)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("parent", pa.binary()), ("off", pa.int32()), ("key", pa.int64()), ("seg", pa.binary()), ("text", pa.binary()), ("n", pa.int32()), ("anchor", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("m", pa.int64())]))

    here = segments.mapInArrow(cold, _SHARD) if hot else segments
    found = here.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(index, f"seg binary, m long, runs {_RUNS}")
    if not hot:
        return found
    split = scratch.write(segments.mapInArrow(parts, f"parent binary, off int, {_SHARD}"), f"split{level}")
    below = scratch.write(split.groupBy("key", "seg", "text", "n", "anchor", "low", "high").agg(F.sum("m").alias("m")), f"below{level}")
    runs = scratch.write(_decided(spark, scratch, below, level + 1, by_word, window, index), f"runs{level}")
    shared = split.groupBy("seg").agg(F.count(F.lit(1)).alias("parents"))
    back = heavy_left_join(split.select("seg", "parent", "off", F.col("m").alias("own")), scratch.write(runs.select("seg", "runs").join(shared, "seg"), f"shared{level}"), "seg", "parents", split.count()).filter("runs is not null")
    back = back.select("parent", "own", F.transform("runs", lambda r: F.struct((F.col("off") + r["a"]).alias("a"), (F.col("off") + r["b"]).alias("b"))).alias("runs"))
    # at most `window` parts a segment
    back = back.groupBy(F.col("parent").alias("seg")).agg(F.max("own").alias("m"), F.flatten(F.collect_list("runs")).alias("runs"))
    return found.unionByName(back)


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str,
    text_col: str,
    by_word: bool,
    window: int,
    k: int,
    resolve: Callable[[list[dict]], Iterator[tuple[int, np.ndarray]]],
) -> DataFrame:
    """One row per row of `docs`: id, n_units, n_removed, n_spans, kept (binary).

    `resolve` gets a shard, dicts with key, seg, m, n, anchor, text (words joined by one space), keys whole; it
    yields places in that list and masks of the windows that occur twice, segments counted `m` times.
    Null texts are empty; an empty table gives an empty result; rows of equal identifier and text get equal
    results; other columns are not read.
    """
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # the identity of a row by content: stable over scans; rows that share it get the same result
    named = rows.select(F.xxhash64(F.lit(1), "id", "text").alias("k1"), F.xxhash64(F.lit(2), "id", "text").alias("k2"), "id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                key, *_ = _segments(data, offsets, by_word, window, k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    keys = rows.select("text").mapInArrow(count, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    repeated = KeyFilter(spark, scratch.write(keys.filter("c > 1").select("key"), "keys"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                key, first, n, anchor, data, starts, ends, cuts = _segments(data, offsets, by_word, window, k)
                some = np.flatnonzero(repeated.has(key))
                key, first, n, anchor = key[some], first[some], n[some], anchor[some]
                row = np.searchsorted(cuts, first, "right") - 1
                raw, seg, m, content, seen = data.tobytes(), [], [], [], {}
                for a, b in zip(starts[first].tolist(), ends[first + n + window - 2].tolist(), strict=True):
                    part = raw[a:b]
                    name = _name(part)
                    at = seen.setdefault(name, len(seg))
                    seg.append(name)
                    m.append(1 if at == len(m) else 0)
                    content.append(part if at == len(content) else None)
                    if at != len(m) - 1:
                        m[at] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo + row]), pa.array(k2[lo + row]), pa.array((first - cuts[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg, pa.binary()), pa.array(m, pa.int64()), pa.array(content, pa.binary())],
                    names=["k1", "k2", "at", "n", "anchor", "key", "seg", "m", "text"],
                )

    schema = "k1 long, k2 long, at int, n int, anchor int, key long, seg binary, m long, text binary"
    segments = scratch.write(named.select("k1", "k2", "text").mapInArrow(emit, schema), "segments")
    distinct = segments.filter("text is not null").groupBy("key", "seg", "text", "n", "anchor").agg(F.sum("m").alias("m"))
    distinct = scratch.write(distinct.select("key", "seg", "text", "n", "anchor", F.lit(0).alias("low"), F.lit(window - k).alias("high"), "m"), "distinct")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (_SHARD) sorted by key and name; cut into shards at key changes."""

        def decided(shard: list[dict]) -> pa.RecordBatch:
            segs, m, runs = [], [], []
            for at, mask in resolve(shard):
                edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                segs.append(shard[at]["seg"])
                m.append(shard[at]["m"])
                runs.append([{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array(m, pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["seg", "m", "runs"])

        shard, held, own = [], 0, 0  # own: segments of the last key
        for batch in batches:
            for x in batch.to_pylist():
                if shard and x["key"] != shard[-1]["key"]:
                    if own == 1 and shard[-1]["m"] == 1:  # let through by the filter only
                        held -= shard.pop()["n"] + window
                    own = 0
                    if held >= SHARD_UNITS:
                        yield decided(shard)
                        shard, held = [], 0
                elif shard and x["seg"] == shard[-1]["seg"]:
                    raise ValueError("two texts of one digest")
                shard.append(x)
                own += 1
                held += x["n"] + window
        if shard:
            yield decided(shard)

    runs = scratch.write(_decided(spark, scratch, distinct, 0, by_word, window, index), "runs")
    placed = heavy_left_join(segments.select("k1", "k2", "at", "seg"), runs, "seg", "m", segments.count()).filter("runs is not null")
    placed = placed.select("k1", "k2", F.transform("runs", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b"))).alias("runs"))
    # rows of equal identifier and text have equal runs, which a set keeps once
    marks = scratch.write(placed.groupBy("k1", "k2").agg(F.flatten(F.collect_set("runs")).alias("runs")), "marks")
    scratch.drop("keys", "segments", "distinct", "runs", *(f"{x}{i}" for x in ("split", "below", "runs", "shared") for i in range(window.bit_length() + 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_units, n_removed, n_spans, kept = [], [], [], []
            ranges = batch.column(2)
            begins = np.concatenate([[0], np.cumsum(np.nan_to_num(ranges.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            flat = ranges.flatten()
            a, b = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                starts, ends, cuts = units(data, offsets, by_word)
                part = slice(begins[lo], begins[hi])
                base = np.repeat(cuts[:-1], np.diff(begins[lo : hi + 1]))
                delta = np.zeros(len(starts) + 1, np.int64)
                np.add.at(delta, base + a[part], 1)
                np.add.at(delta, base + b[part] + window, -1)
                gone = np.cumsum(delta[:-1]) > 0
                before = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = cuts[:-1][cuts[:-1] < len(gone)]
                opens[inner] = gone[inner]
                spans = np.concatenate([[0], np.cumsum(opens)])
                n_units.append(np.diff(cuts))
                n_removed.append(np.diff(before[cuts]))
                n_spans.append(np.diff(spans[cuts]))
                if by_word:  # kept words, and the first gap byte after each but the last of a document
                    stay = np.flatnonzero(~gone)
                    doc = np.searchsorted(cuts, stay, "right") - 1
                    more = np.append(doc[1:] == doc[:-1], False)[: len(stay)]
                    edge = np.zeros(len(data) + 1, np.int8)
                    edge[starts[stay]] += 1
                    edge[ends[stay] + more] -= 1
                    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
                    data = data.copy()
                    data[ends[stay[more]]] = 0x20
                else:
                    mask = ~gone
                size = np.concatenate([[0], np.cumsum(mask)])[offsets]
                kept.append(pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[mask].tobytes())]).cast(pa.binary()))
            join = lambda x: pa.array(np.concatenate(x))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0), join(n_units), join(n_removed), join(n_spans), pa.concat_arrays(kept)], names=["id", "n_units", "n_removed", "n_spans", "kept"])

    marked = named.join(marks, ["k1", "k2"], "left").select("id", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    return marked.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, n_units long, n_removed long, n_spans long, kept binary")
