"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits and link at `NEAR` = 4 or fewer differing bits. They are cut into pieces of
23, 23 and 18 bits. Two linked fingerprints differ by at most 1 bit in the first piece, or by at most
1 in the second, or not at all in the third (else by 2 + 2 + 1 = 5 or more). The anchors of a piece
are the words of a covering code: the binary Golay code for 23 bits (covering radius 3), all words for
18 bits (radius 0). Each fingerprint is at home at its nearest anchor and is replicated to every
anchor within covering radius plus threshold (4, or 0), 5.3 of them on average; so each linked pair
meets at the home of either one, where home and replicated fingerprints are compared.

Equal fingerprints are one row before that. An anchor sends only a spanning forest of the links it
finds, at most one row per fingerprint it holds; links between different fingerprints are never lost, since
components, not pairs, are what counts. An anchor with over `HOMES` homes is covered once more by the other two
pieces: the pair differs by at most 2 bits in one (anchors within 3 + 2), or by at most 1, or 2, in the other, so rows
grow by a constant factor while an anchor holds a thousandth of the homes. Only an anchor that is crowded in two
pieces is split into blocks of homes times blocks of all that is replicated there. Components come from alternating large-star and
small-star steps over written tables; no links or labels reach the driver.

Defined results: null and empty texts have fingerprint zero and link like others; repeated rows have
a result each; null identifiers never name a component unless all its identifiers are null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import blocks, single_spaced, words
from .common import KEY, Scratch, heavy_left_join, table, with_key

SHINGLE, NEAR, SEED = 4, 4, 42
#: homes, and all rows, of one anchor or block that one task compares, about
HOMES, ROWS = 8192, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi, data, offsets in blocks(texts):
        starts, ends, cuts = words(data, offsets)
        if not len(starts):
            continue
        flat, starts, ends = single_spaced(_LOWER[data], starts, ends)
        flat = flat.tobytes()
        n = np.diff(cuts)
        count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(hi - lo), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + cuts[:-1][row]
        last = np.minimum(at + SHINGLE, cuts[1:][row]) - 1
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(row))
        some = np.flatnonzero(count)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
        major = (2 * totals > count[some, None]).astype(np.uint8)
        out[lo + some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts).view(np.int64))


# ---- anchors -----------------------------------------------------------------------------------

_GOLAY = 0xAE3  # generator polynomial of the binary Golay code of length 23 (fixed value)
_golay: tuple[np.ndarray, dict[int, np.ndarray]] | None = None

#: lowest bit and number of bits of the pieces
PIECES = ((0, 23), (23, 23), (46, 18))
#: bits in which a linked pair differs at most in a piece, at first and, for the pieces besides it, inside a crowded anchor
FIRST = (1, 1, 0)
WITHIN = {0: ((1, 2), (2, 1)), 1: ((0, 2), (2, 1)), 2: ((0, 2), (1, 2))}


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GOLAY << (bit - 11)
    return word


def golay() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Syndromes of the 23 bits; for the radii 3 to 5 and each syndrome all error patterns of at most so many bits
    that have it, the lightest first, then -1."""
    global _golay
    if _golay is None:
        from itertools import combinations

        syndromes = np.array([_remainder(1 << i) for i in range(23)], np.int64)
        errors, radius = [[] for _ in range(2048)], {}
        for weight in range(6):
            for places in combinations(range(23), weight):
                s = int(np.bitwise_xor.reduce(syndromes[list(places)])) if places else 0
                errors[s].append(sum(1 << p for p in places))
            if weight >= 3:
                radius[weight] = np.full((2048, max(map(len, errors))), -1, np.int64)
                for s, found in enumerate(errors):
                    radius[weight][s, : len(found)] = found
        _golay = syndromes, radius
    return _golay


def anchors(values: np.ndarray, threshold: int = 1):
    """For 23-bit words: the home anchor, and the other anchors within covering radius plus threshold (or -1)."""
    syndromes, radius = golay()
    s = np.zeros(len(values), np.int64)
    for i in range(23):
        s ^= np.where(values >> i & 1, syndromes[i], 0)
    found = radius[3 + threshold][s]
    return values ^ found[:, 0], np.where(found[:, 1:] >= 0, values[:, None] ^ found[:, 1:], -1)


def _covering(u: np.ndarray, piece: int, threshold: int):
    """The home anchor of each fingerprint in a piece, and the others within covering radius plus threshold (or -1)."""
    shift, bits = PIECES[piece]
    value = (u >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
    if bits == 23:
        return anchors(value, threshold)
    flips = np.array([1 << i for i in range(bits)] if threshold else [], np.int64)
    return value, value[:, None] ^ flips[None, :]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, within, home, fp) of fingerprints; the piece is in the top bits of the anchor, `within` is 0."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        at, home, what = [], [], []
        for piece, threshold in enumerate(FIRST):
            own, more = _covering(fp.view(np.uint64), piece, threshold)
            row, col = np.nonzero(more >= 0)
            at += [own | piece << 32, more[row, col] | piece << 32]
            home += [np.ones(len(fp), bool), np.zeros(len(row), bool)]
            what += [fp, fp[row]]
        at = np.concatenate(at)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int64)), pa.array(np.concatenate(home)), pa.array(np.concatenate(what))], names=["anchor", "within", "home", "fp"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, within, home, fp) of crowded anchors, covered in a second piece. A home has one home there
    and is replicated like all others; `within` is above 0."""
    for batch in batches:
        for lo in range(0, len(batch), 2000):
            part = batch.slice(lo, 2000)
            anchor, home, fp = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy()
            out = [[], [], [], []]
            for piece, others in WITHIN.items():
                rows = np.flatnonzero(anchor >> 32 == piece)
                for other, threshold in others:
                    own, more = _covering(fp[rows].view(np.uint64), other, threshold)
                    i, col = np.nonzero(more >= 0)
                    for to, which, here in ((own, rows, home[rows]), (more[i, col], rows[i], np.zeros(len(i), bool))):
                        for column, values in zip(out, (anchor[which], to | (other + 1) << 32, here, fp[which]), strict=True):
                            column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["anchor", "within", "home", "fp"])


def forest(home: np.ndarray, other: np.ndarray):
    """Links (fp, root) that span the components of the pairs within NEAR bits, of which one is in `home`."""
    fps = np.unique(np.concatenate([home, other]))
    mine = np.searchsorted(fps, home)
    parent = np.arange(len(fps))
    step = max(1, (1 << 20) // max(1, len(fps)))
    for lo in range(0, len(home), step):
        i, j = np.nonzero(np.bitwise_count(home[lo : lo + step, None] ^ fps[None, :]) <= NEAR)
        i = mine[lo + i]
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            # hang larger labels under smaller ones, then flatten all paths
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[moved], fps[parent[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, within, block, home, fp), those of an anchor and block together; yields links."""

    def links(home: list, fps: list) -> pa.RecordBatch | None:
        h, f = np.concatenate(home), np.concatenate(fps).view(np.uint64)
        if len(f) < 2 or not h.any():
            return None
        a, b = forest(f[h], f[~h])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

    last, homes, fps, out, rows = None, [], [], [], 0
    for batch in batches:
        anchor, within, block = (batch.column(i).to_numpy() for i in range(3))
        home, fp = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
        if not len(fp):
            continue
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (within[1:] != within[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            key = (anchor[lo], within[lo], block[lo])
            if key != last and homes:
                if (done := links(homes, fps)) is not None:
                    out.append(done)
                    rows += len(done)
                homes, fps = [], []
            last = key
            homes.append(home[lo:hi])
            fps.append(fp[lo:hi])
            if rows > 10_000:
                yield from out
                out, rows = [], 0
    if homes and (done := links(homes, fps)) is not None:
        out.append(done)
    yield from out


def near_links(spark: SparkSession, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect exactly the components of the distinct fingerprints `fp`."""
    kind = "anchor long, within long, home boolean, fp long"
    spread = scratch.write(distinct.select("fp").mapInArrow(_replicate, kind), "replicated")

    def crowds(df: DataFrame) -> DataFrame:
        """Anchors of too many rows, with the number of their blocks of homes (0 without homes) and of other rows."""
        size = df.groupBy("anchor", "within").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("rows"))
        size = size.filter((F.col("homes") > HOMES) | (F.col("rows") > ROWS))
        return size.select("anchor", "within", F.expr(f"cast(ceil(homes / {HOMES}) as int)").alias("tall"), F.expr(f"cast(ceil(rows / {ROWS}) as int)").alias("wide"))

    # at most as many rows as there are anchors: 2 x 4,096 + 262,144
    crowded = scratch.write(crowds(spread), "crowded")
    dealt = spread.withColumn("block", F.lit(0))
    if crowded.limit(1).count():
        inner = spread.join(F.broadcast(crowded.filter("tall > 0").select("anchor")), "anchor").select("anchor", "within", "home", "fp")
        inner = scratch.write(inner.mapInArrow(_again, kind), "inner")
        sized = inner.join(crowds(inner), ["anchor", "within"], "left").filter("tall is null or tall > 0").withColumns({"tall": F.coalesce("tall", F.lit(1)), "wide": F.coalesce("wide", F.lit(1))})
        # each block of homes meets each block of rows: homes go along their row of blocks and, as other rows, down their column
        sized = sized.withColumns({"i": F.expr("cast(pmod(xxhash64(fp), tall) as int)"), "j": F.expr("cast(pmod(xxhash64(1, fp), wide) as int)")})
        along = "if(home, transform(sequence(0, wide - 1), x -> named_struct('block', i * wide + x, 'home', true)), array())"
        down = "transform(filter(sequence(0, tall - 1), x -> not home or x <> i), x -> named_struct('block', x * wide + j, 'home', false))"
        blocked = sized.select("anchor", "within", "fp", F.explode(F.expr(f"concat({along}, {down})")).alias("x")).select("anchor", "within", "x.home", "fp", "x.block")
        dealt = dealt.join(F.broadcast(crowded.select("anchor")), "anchor", "left_anti").select(*dealt.columns).unionByName(blocked)
    dealt = dealt.select("anchor", "within", "block", "home", "fp").repartition("anchor", "within", "block").sortWithinPartitions("anchor", "within", "block")
    return scratch.write(dealt.mapInArrow(_compare, "a long, b long").distinct(), "links")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating stars: (v, root) for every vertex that is not its root."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    state, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("v"), F.col("v").alias("root")))
        # large star: neighbours above a vertex go to the smallest vertex around it
        least = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("root > v").select(F.col("root").alias("v"), F.col("m").alias("root")).filter("v <> root").distinct()
        # small star: a vertex and its neighbours below go to the smallest of them
        least = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).unionByName(least.select("v", F.col("m").alias("root")))
        edges = scratch.write(small.filter("v <> root").distinct(), f"stars{turn}")
        if turn:
            scratch.drop(f"stars{turn - 1}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "root"))).first())
        if now == state:
            return edges
        state, turn = now, turn + 1


def named_components(rows: DataFrame, distinct: DataFrame, stars: DataFrame, scratch: Scratch) -> DataFrame:
    """id, fp, component of `rows` (id, fp), from `distinct` (fp, least, n) and the stars (v, root) of its fps."""
    rooted = distinct.join(stars.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.write(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("size"))
    named = heavy_left_join(rooted, scratch.write(names, "names"), "root", "size", rooted.count())
    return heavy_left_join(rows, scratch.write(named.select("fp", "n", "component"), "named"), "fp", "n", rows.count()).select("id", "fp", "component")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, fp, component (smallest identifier reachable)."""
    scratch = Scratch(spark)
    rows = scratch.write(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col).cast("string")).alias("fp")), "fingerprints")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    stars = components(spark, near_links(spark, distinct, scratch), scratch)
    scratch.drop("replicated", "crowded", "inner", "links")
    return named_components(rows, distinct, stars, scratch)


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of `docs`, the one with the smallest identifier (null last, ties by
    a hash of the text), with its columns."""
    keyed, repeated = with_key(docs, id_col, text_col)
    found = near_duplicates(spark, keyed, KEY, text_col)
    dropped = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(KEY))
    kept = keyed.join(dropped, KEY, "left_anti")
    return (kept.dropDuplicates([KEY]) if repeated else kept).select(*docs.columns)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
