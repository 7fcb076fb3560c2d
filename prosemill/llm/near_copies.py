"""Near copies by word shingles: SimHash with anchor points finds candidates, the whole shingle sets decide.

A text is the set of its runs of `SHINGLE` lower-cased words (all words, if fewer); texts link at a Jaccard
similarity of `SIMILAR_PERCENT` or more. Equal sets are one row at first. The fingerprint is operator 8's, the majority
of each bit of the shingle hashes, with `WORDS` words of 64 bits: at similarity 0.8 a bit differs with chance 0.15, so
one word with a bound of 4 bits, which operator 8's contract asks for, would miss most such pairs.

The bits are cut into `PIECES` pieces of 23. As in operator 8, a fingerprint is at home at the nearest word of the binary
Golay code and is replicated to those within covering radius plus one (5.3 anchors a piece in all), and homes are
compared with all that is at their anchor. They link if the three words from the piece's own on differ in `NEAR` or
fewer of 192 bits, and an anchor sends a forest of its links. What the first `FIRST` pieces have connected is one in the
others, so a large group sends few links. A pair at similarity 0.8 meets in a piece with chance 0.39 and in none of them
with chance 2e-5; sets of unrelated texts differ in 96 bits.

The components of these links are the candidates. Each set is compared with the centre of its component, the set with
most links, which joins most of a large group by as many comparisons as it has sets. Where the sets of a
component are then still apart, those outside its largest part are compared with all its sets,
in blocks of at most `LEAST` by `MOST` sets; a block is a task's work and sends a spanning forest of its links,
at most a row a set. So components are those of all candidates, and no pairs are written.

Words are told apart by 128 bits of BLAKE2, shingles by two 64-bit hashes over those of their words, and equal sets are
those of one 128-bit BLAKE2 digest over all their shingles; sets are numbered, so none shares another's number.

Defined results: null and empty texts have the empty set, which links with itself only; otherwise as in
simhash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import SPACE, U64, blocks, mix, prefix, span_hash, spread, words
from .common import KEY, BitFilter, Scratch, heavy_left_join, with_key
from .simhash import anchors, components, named_components

SHINGLE, SIMILAR_PERCENT = 5, 80
WORDS, NEAR = 8, 46
PIECES, BITS, ANCHORS = 22, 23, 1 << 12
#: pieces of the first round; in the second, what they have connected is one
FIRST = 2
#: homes, and all rows, of one anchor or block that one task compares, about
HOMES, ROWS = 8192, 1 << 17
#: anchors are counted on every so manieth set, to size their blocks
COUNTED = 16
#: sets outside the largest part, and all sets of a component, that one block compares, about
LEAST, MOST = 1024, 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SALTS = mix(np.arange(1, WORDS + 1, dtype=U64))


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of 128 bits of BLAKE2 per word, computed once per different word."""
    bounds = pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64).tobytes())
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data[~SPACE[data]].tobytes())]).dictionary_encode()
    known = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist())
    halves = np.frombuffer(known, U64).reshape(-1, 2)[coded.indices.to_numpy()]
    return halves[:, 0].copy(), halves[:, 1].copy()


def shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, two hashes of the shingles of a block, index of each row's first one and the end)."""
    for lo, _, data, offsets in blocks(texts):
        data = _LOWER[data]
        starts, ends, cuts = words(data, offsets)
        n = np.diff(cuts)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        at = spread(cuts[:-1], count)
        last = np.minimum(at + SHINGLE, np.repeat(cuts[1:], count))
        yield lo, *(span_hash(prefix(half), at, last) for half in _words(data, starts, ends)), np.concatenate([[0], np.cumsum(count)])


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    return [np.unique(h[a:b]) for _, h, _, cuts in shingles(texts) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _named_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[bytes]]:
    """`sets`, and a digest of each over both hashes of all its shingles."""
    found, names = [], []
    for _, h, second, cuts in shingles(texts):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            order = np.lexsort((second[a:b], h[a:b]))
            one, two = h[a:b][order], second[a:b][order]
            new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
            found.append(np.unique(one))
            names.append(hashlib.blake2b(one[new].tobytes() + two[new].tobytes(), digest_size=16).digest())
    return found, names


def fingerprints(found: list[np.ndarray]) -> np.ndarray:
    """A row of `WORDS` words of 64 bits for each set of hashes; a bit is 1 if set in over half of them."""
    count = np.array([len(x) for x in found], np.int64)
    totals = np.zeros((len(found), 64 * WORDS), np.int32)
    flat, row = np.concatenate([np.zeros(0, U64), *found]), np.repeat(np.arange(len(found)), count)
    for lo in range(0, len(flat), 1 << 15):
        h, own = flat[lo : lo + (1 << 15)], row[lo : lo + (1 << 15)]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for w, salt in enumerate(_SALTS):
            # four sums of 16 bits a number
            x = mix(h ^ salt)
            lanes = np.stack([np.add.reduceat(x >> U64(i) & U64(0x0001000100010001), first) for i in range(16)], axis=1)
            for lane in range(4):
                at = 64 * w + 16 * lane
                totals[own[first], at : at + 16] += (lanes >> U64(16 * lane) & U64(0xFFFF)).astype(np.int32)
    return np.packbits(2 * totals > count[:, None], axis=1, bitorder="little").view(U64).reshape(-1, WORDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, names = _named_sets(batch.column(1))
        size = np.array([len(x) for x in found], np.int64)
        bits = pa.FixedSizeListArray.from_arrays(pa.array(fingerprints(found).view(np.int64).ravel()), WORDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(size), bits], names=["id", "set", "size", "bits"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The columns fp and bits of a batch, the latter as a row of words each."""
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(U64).reshape(-1, WORDS)


def _anchored(bits: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the home anchor of each row; row and number of the other anchors of rows). A word of the code is known by
    its upper 12 bits."""
    word, shift = divmod(BITS * piece, 64)
    value = bits[:, word] >> U64(shift)
    if shift > 64 - BITS:
        value |= bits[:, word + 1] << U64(64 - shift)
    own, more = anchors((value & U64((1 << BITS) - 1)).astype(np.int64))
    row, col = np.nonzero(more >= 0)
    return own >> 11 | piece << 12, row, more[row, col] >> 11 | piece << 12


def _counts(pieces: range):
    """How many homes and rows there are at each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, rows = np.zeros((2, PIECES * ANCHORS), np.int64)
        for batch in batches:
            _, bits = _unpacked(batch)
            for piece in pieces:
                own, _, more = _anchored(bits, piece)
                np.add.at(homes, own, 1)
                np.add.at(rows, own, 1)
                np.add.at(rows, more, 1)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(homes[at]), pa.array(rows[at])], names=["anchor", "homes", "rows"])

    return run


def _replicate(pieces: range, tall: dict[int, int], wide: dict[int, int]):
    """Rows (key, fp, x, y, z) of fingerprints: key is the anchor, its block and, in the lowest bit, 0 for homes; x to z are the
    words compared. In an anchor of tall by wide blocks homes go along their row of blocks and, as other rows, all go down their column."""
    across, down = np.ones((2, PIECES * ANCHORS), np.int64)
    across[list(wide)], down[list(tall)] = list(wide.values()), list(tall.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, bits = _unpacked(batch)
            dealt, every = np.zeros(len(fp), U64), np.arange(len(fp))
            for word in range(WORDS):
                dealt = mix(dealt ^ bits[:, word])
            line, column = (dealt >> U64(32)).astype(np.int64), (dealt & U64(0xFFFFFFFF)).astype(np.int64)
            for piece in pieces:
                own, more_row, more = _anchored(bits, piece)
                line_of = line % down[own]
                # homes along their line
                home_row = np.repeat(every, across[own])
                home_block = line_of[home_row] * across[own][home_row] + spread(np.zeros(len(own), np.int64), across[own])
                # all rows down their column, homes not in the block where they are homes
                row, anchor = np.concatenate([every, more_row]), np.concatenate([own, more])
                times = down[anchor]
                which = np.repeat(np.arange(len(row)), times)
                level = spread(np.zeros(len(row), np.int64), times)
                keep = (which >= len(fp)) | (level != line_of[np.minimum(which, len(fp) - 1)])
                which, level = which[keep], level[keep]
                other_block = level * across[anchor[which]] + column[row[which]] % across[anchor[which]]
                key = np.concatenate([own[home_row] << 33 | home_block << 1, anchor[which] << 33 | other_block << 1 | 1])
                row = np.concatenate([home_row, row[which]])
                word = BITS * piece // 64
                three = [pa.array(bits[row, (word + i) % WORDS].view(np.int64)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), *three], names=["key", "fp", "x", "y", "z"])

    return run


def forest(fp: np.ndarray, bits: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, n) between different fps, b being the smallest of a part, and n the links that `a` was seen to have. The parts
    are what links within `NEAR` bits of one of the first `homes` rows make of all; rows of one fp are one part.

    Homes of the largest part are compared only with rows outside it, so a large group costs as many comparisons as it has rows.
    """
    n = len(bits)
    fps, first, part = np.unique(fp, return_index=True, return_inverse=True)
    part, links = first[part], np.zeros(n, np.int64)
    step = max(16, min(256, (1 << 20) // n))
    for lo in range(0, homes, step):
        chunk = np.arange(lo, min(lo + step, homes))
        main = np.bincount(part).argmax()
        outside = np.flatnonzero(part != main)
        if not len(outside):
            break
        inner = part[chunk] == main
        for mine, against in ((chunk[inner], outside), (chunk[~inner], np.arange(n))):
            if not len(mine) or not len(against):
                continue
            apart = sum(np.bitwise_count(bits[mine, None, w] ^ bits[None, against, w]) for w in range(3))
            i, j = np.nonzero(apart <= NEAR)
            i, j = mine[i], against[j]
            i, j = i[i != j], j[i != j]
            links += np.bincount(i, minlength=n)
            while len(i):
                a, b = part[i], part[j]
                differ = a != b
                i, j, a, b = i[differ], j[differ], a[differ], b[differ]
                if not len(i):
                    break
                # hang larger labels under smaller ones, then flatten all paths
                np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
                while (part[part] != part).any():
                    part = part[part]
    # the same few hubs at all anchors of a large group, so few different links; fps ascend
    hub = np.full(n, len(fps))
    np.minimum.at(hub, part[first], np.arange(len(fps)))
    hub = hub[part[first]]
    moved = np.flatnonzero(hub != np.arange(len(fps)))
    return fps[moved], fps[hub[moved]], links[first[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, x, y, z) in the order of keys; yields links (a, b, n), where `a` was seen to have n links."""

    def done(parts: list) -> Iterator[pa.RecordBatch]:
        """The whole groups in `parts`."""
        key, fp, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        edge = np.flatnonzero(np.diff(key >> 1, prepend=-1))
        homes = np.add.reduceat((key & 1) == 0, edge, dtype=np.int64)
        size = np.diff(np.append(edge, len(key)))
        out: tuple[list, ...] = tuple([np.zeros(0, np.int64)] for _ in range(3))
        for g in np.flatnonzero((homes > 0) & (size > 1)).tolist():
            lo, hi = edge[g], edge[g] + size[g]
            for column, values in zip(out, forest(fp[lo:hi], bits[lo:hi], homes[g]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b", "n"])

    held: list = []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        bits = np.stack([batch.column(c).to_numpy().view(U64) for c in (2, 3, 4)], axis=1)
        # the last group may go on in the next batch
        whole = int(np.searchsorted(key >> 1, key[-1] >> 1))
        if held and (whole or held[-1][0][-1] >> 1 != key[0] >> 1):
            yield from done([*held, (key[:whole], fp[:whole], bits[:whole])])
            held = []
        elif whole:
            yield from done([(key[:whole], fp[:whole], bits[:whole])])
        held.append((key[whole:], fp[whole:], bits[whole:]))
    if held:
        yield from done(held)


def near_links(sets: DataFrame, pieces: range, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b, n) that connect the `fp` of fingerprints `bits` that meet at an anchor and are near; n sums up the links
    that `a` was seen to have where it has this one. Rows of one fp are connected already."""
    # at most as many rows as there are anchors: 22 x 4,096
    counts = sets.filter(F.pmod(F.xxhash64("bits"), F.lit(COUNTED)) == 0).mapInArrow(_counts(pieces), "anchor long, homes long, rows long")
    counts = counts.groupBy("anchor").agg((COUNTED * F.sum("homes")).alias("homes"), (COUNTED * F.sum("rows")).alias("rows"))
    crowded = counts.filter((F.col("homes") > HOMES) | (F.col("rows") > ROWS)).collect()
    deal = _replicate(pieces, {r.anchor: max(1, -(-r.homes // HOMES)) for r in crowded}, {r.anchor: -(-r.rows // ROWS) for r in crowded})
    dealt = sets.mapInArrow(deal, "key long, fp long, x long, y long, z long").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return scratch.write(dealt.mapInArrow(_compare, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), name)


def candidates(spark: SparkSession, distinct: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The components (v, root) of near fingerprints, for every set that is not its root, and the links (a, b, n) behind them."""
    some = distinct.filter("size > 0").select("fp", "bits")
    near = near_links(some, range(FIRST), scratch, "near")
    stars = components(spark, near, Scratch(spark))
    joined = some.join(stars.withColumnRenamed("v", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("fp"), "bits")
    rest = near_links(scratch.write(joined, "joined"), range(FIRST, PIECES), scratch, "near_rest")
    known = stars.select(F.col("v").alias("a"), F.col("root").alias("b"))
    return components(spark, known.unionByName(rest.select("a", "b")), Scratch(spark)), near.unionByName(rest)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [x.view(np.int64) for x in sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["fp", "grams"])


def _similar(pairs: DataFrame, grams: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    total = pairs.count()
    for side in ("a", "b"):
        often = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("uses"))
        right = grams.withColumnRenamed("fp", side).withColumnRenamed("grams", f"g{side}").join(often, side)
        pairs = heavy_left_join(pairs, scratch.write(right, f"{name}_{side}"), side, "uses", total).drop("uses")
    both = F.size(F.array_intersect("ga", "gb"))
    either = F.size("ga") + F.size("gb") - both
    return scratch.write(pairs.filter(100 * both >= SIMILAR_PERCENT * either).select("a", "b"), name)


class _Homes:
    """The sets of a block that are compared with all others, as lists of the sets that hold each shingle."""

    def __init__(self, fp: list[int], root: list[int], grams: list[np.ndarray]):
        self.fp, self.root, self.grams = np.array(fp), np.array(root), grams
        self.sizes = np.array([len(g) for g in grams])
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.known, self.first = np.unique(flat[order], return_index=True)
        self.count, self.owner = np.diff(np.append(self.first, len(flat))), owner[order]

    def keep(self, some: np.ndarray) -> _Homes:
        return _Homes(self.fp[some].tolist(), self.root[some].tolist(), [self.grams[i] for i in some.tolist()])

    def shared(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """How many shingles each of the sets flat[cuts[i]:cuts[i+1]] shares with each home."""
        n, homes = len(cuts) - 1, len(self.grams)
        row = np.repeat(np.arange(n), np.diff(cuts))
        at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = self.known[at] == flat
        row, at = row[hit], at[hit]
        out = np.zeros((n, homes), np.int64)
        used, column = np.unique(at, return_inverse=True)
        entries = int(self.count[at].sum())
        if entries <= 1 << 24 and entries * 32 <= n * homes * len(used):  # few shingles in common: add up the lists
            pairs = np.repeat(row, self.count[at]) * homes + self.owner[spread(self.first[at], self.count[at])]
            return np.bincount(pairs, minlength=n * homes).reshape(n, homes)
        for lo in range(0, len(used), 4096):  # many: multiply incidence matrices
            here = (column >= lo) & (column < lo + 4096)
            width = min(4096, len(used) - lo)
            left, right = np.zeros((n, width), np.float32), np.zeros((width, homes), np.float32)
            left[row[here], column[here] - lo] = 1
            part = used[lo : lo + width]
            right[np.repeat(np.arange(width), self.count[part]), self.owner[spread(self.first[part], self.count[part])]] = 1
            out += (left @ right).astype(np.int64)
        return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, home, fp, root, main, grams), those of a key and block together and its homes first: links
    (a, b) that span what the homes' similarity to all sets of the block connects, roots being connected already.

    Homes that have come to the component of `main` are done: a set outside it is compared with them where it is
    a home itself.
    """
    last, gathered, homes, up = None, ([], [], []), None, {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for batch in batches:
        key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        home = batch.column(2).to_numpy(zero_copy_only=False)
        fp, root, main = (batch.column(c).to_numpy() for c in (3, 4, 5))
        cuts, flat = batch.column(6).offsets.to_numpy().astype(np.int64), batch.column(6).values.to_numpy()
        out: list[tuple[int, int]] = []
        edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (home[1:] != home[:-1])) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            if lo == hi:
                continue
            if (key[lo], block[lo]) != last:
                last, gathered, homes, up = (key[lo], block[lo]), ([], [], []), None, {}
            if home[lo]:
                for column, values in zip(gathered, (fp[lo:hi].tolist(), root[lo:hi].tolist(), [flat[cuts[i] : cuts[i + 1]].copy() for i in range(lo, hi)]), strict=True):
                    column.extend(values)
                continue
            if not gathered[0]:
                continue
            homes = homes or _Homes(*gathered)
            for a in range(lo, hi, 256):
                b, to = min(a + 256, hi), top(int(main[lo]))
                still = np.flatnonzero(homes.root != to)
                if not len(still):
                    break
                if 2 * len(still) <= len(homes.fp):
                    homes = homes.keep(still)
                both = homes.shared(flat[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])
                size = np.diff(cuts[a : b + 1])
                near = 100 * both >= SIMILAR_PERCENT * (size[:, None] + homes.sizes[None, :] - both)
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    own = top(int(root[a + i]))
                    found, at = np.unique(homes.root[near[i]], return_index=True)
                    for other, h in zip(found.tolist(), np.flatnonzero(near[i])[at].tolist(), strict=True):
                        own, other = top(own), top(other)
                        if own != other:
                            up[other] = own
                            out.append((int(fp[a + i]), int(homes.fp[h])))
                            homes.root[homes.root == other] = own
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])


def _rest(shared: DataFrame, links: DataFrame, grams: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """Links between components of the same key, so that all candidates that are similar are connected."""
    stars = components(spark, links, Scratch(spark))
    labelled = shared.join(stars.withColumnRenamed("v", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.write(labelled, "labelled")
    per_root = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_root.groupBy("key").agg(F.sum("n").alias("sets"), F.max("n").alias("largest"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    mixed = mixed.select("key", "sets", "main", F.ceil((F.col("sets") - F.col("largest")) / LEAST).cast("int").alias("tall"), F.ceil(F.col("sets") / MOST).cast("int").alias("wide"))
    sized = heavy_left_join(labelled, scratch.write(mixed, "mixed"), "key", "sets", labelled.count()).filter("sets is not null")
    sized = sized.withColumns({"minor": F.col("root") != F.col("main"), "i": F.expr("cast(pmod(xxhash64(fp), tall) as int)"), "j": F.expr("cast(pmod(xxhash64(1, fp), wide) as int)")})
    along = "if(minor, transform(sequence(0, wide - 1), x -> named_struct('block', i * wide + x, 'home', true)), array())"
    down = "transform(sequence(0, tall - 1), x -> named_struct('block', x * wide + j, 'home', false))"
    blocks_of = scratch.write(sized.select("key", "fp", "root", "main", F.explode(F.expr(f"concat({along}, {down})")).alias("x")).select("key", "x.block", "x.home", "fp", "root", "main"), "blocks")
    dealt = blocks_of.join(grams, "fp").select("key", "block", "home", "fp", "root", "main", "grams")
    # as many tasks as there are shuffle partitions: the work of a block is far more than its bytes
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "block").sortWithinPartitions("key", "block", F.desc("home"))
    return scratch.write(dealt.mapInArrow(_block_links, "a long, b long"), "more")


def near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fp (number of the shingle set), component (smallest identifier reachable)."""
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.write(texts.mapInArrow(_sketch, f"id {texts.schema['id'].dataType.simpleString()}, set binary, size long, bits array<long>"), "sketches")
    distinct = sketched.groupBy("set").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    distinct = scratch.write(distinct.withColumn("fp", F.monotonically_increasing_id()), "distinct")
    rows = scratch.write(heavy_left_join(sketched.select("id", "set"), distinct.select("set", "fp", "n"), "set", "n", sketched.count()).select("id", "fp"), "rows")
    stars, near = candidates(spark, distinct, scratch)
    # key: the set that names its component of near fingerprints
    stars = stars.select(F.col("root").alias("key"), F.col("v").alias("fp"))
    members = stars.unionByName(stars.select("key", F.col("key").alias("fp")).distinct())
    met = near.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("met"))
    shared = scratch.write(members.join(distinct.select("fp", "size", "least"), "fp").join(met, "fp", "left"), "shared")
    total = shared.count()
    # the set with most links is the centre of its component
    centres = shared.groupBy("key").agg(F.max_by(F.struct("fp", "size"), F.struct("met", "fp")).alias("centre"), F.count(F.lit(1)).alias("held"))
    starred = heavy_left_join(shared, scratch.write(centres, "centres"), "key", "held", total).filter(F.col("fp") != F.col("centre.fp"))
    # sets of other sizes cannot be similar: the smaller one is all they can share
    fits = F.least("size", "centre.size") * 100 >= F.greatest("size", "centre.size") * SIMILAR_PERCENT
    tried = scratch.write(starred.filter(fits).select(F.least("centre.fp", "fp").alias("a"), F.greatest("centre.fp", "fp").alias("b")), "tried")
    # shingle sets of the candidates, from one text of each
    asked = scratch.write(shared.select("fp", F.col("least").alias("id")), "asked")
    whole = BitFilter(asked, F.col("id")).keep(texts, F.col("id")).dropDuplicates(["id"]).join(asked, "id")
    grams = scratch.write(whole.select("fp", "text").mapInArrow(_grams, "fp long, grams array<long>"), "grams")
    links = _similar(tried, grams, scratch, "similar")
    links = scratch.write(links.unionByName(_rest(shared.select("key", "fp"), links, grams, spark, scratch)), "links")
    scratch.drop("near", "joined", "near_rest", "shared", "centres", "tried", "asked", "grams", "similar", "similar_a", "similar_b", "labelled", "mixed", "blocks", "more")
    return named_components(rows, distinct.select("fp", "least", "n"), components(spark, links, Scratch(spark)), scratch)


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of `docs`, the one with the smallest identifier (null last, ties by
    a hash of the text), with its columns."""
    keyed, repeated = with_key(docs, id_col, text_col)
    found = near_copies(spark, keyed, KEY, text_col)
    dropped = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(KEY))
    kept = keyed.join(dropped, KEY, "left_anti")
    return (kept.dropDuplicates([KEY]) if repeated else kept).select(*docs.columns)
