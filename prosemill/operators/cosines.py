"""All pairs of a cohort's vectors by blocks: what reports say of the pairs, without a row per pair.

Items of a cohort are dealt into blocks by hash, and each two blocks meet in one task, a cell. The task multiplies the two
matrices of a cell, tile by tile, and gives out what a report asks of these pairs: their number, moments and extremes,
sums per item, counts per bin, or the pairs between two bounds. Blocks are files in the shared folder, shuffled and written
once; a cell is a row of two names, and its task reads the two. So the work is a matrix product, disk grows with the vectors
and not with their square, and memory is one cell and one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: bytes of vectors in a block, about, and the most and least items
BLOCK_BYTES, MOST_ITEMS, LEAST_ITEMS = 2 << 20, 8192, 256
#: rows and columns of a tile
ROWS, COLUMNS = 128, 512
#: similarities are ranked to nine places: as whole numbers from the top, in bins of so many
ONE, BIN = 10**9, 1 << 16
BINS = ONE // BIN + 1
BANDS = ("top", "middle", "bottom")


def _unit(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1, a row each, and their sizes. A zero vector stays; one that is null or holds a null has size -1."""
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = v.flatten(), np.repeat(np.arange(len(v)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(v), int(size.max(initial=0))))
    out[row, at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    void = pc.is_null(v).to_numpy(zero_copy_only=False).copy()
    void[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
    out[void], size[void] = 0, -1
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        out /= np.where(norm == 0, 1, norm)[:, None]
    return out, size


class _Cell:
    """Two blocks of a cohort, or one with itself: items in order, and the similarities of their pairs."""

    def __init__(self, left: pa.ListArray, right: pa.ListArray | None):
        (self.left, v), (self.right, w) = left.flatten().flatten(), (right if right is not None else left).flatten().flatten()
        self.own = right is None
        rank = pc.rank(pa.concat_arrays([self.left, self.right]), tiebreaker="dense").to_numpy().astype(np.int64)
        self.i, self.j = rank[: len(self.left)], rank[len(self.left) :]
        self.left, self.i, self.a, self.a_size = _ordered(self.left, self.i, v)
        self.right, self.j, self.b, self.b_size = (self.left, self.i, self.a, self.a_size) if self.own else _ordered(self.right, self.j, w)
        wide = max(self.a.shape[1], self.b.shape[1])
        self.a, self.b = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (self.a, self.b))
        sizes = np.concatenate([self.a_size, self.b_size])
        self.alike = bool((sizes == sizes[0]).all())
        self.finite = bool(np.isfinite(self.a).all() and np.isfinite(self.b).all())

    def tiles(self) -> Iterator[_Tile]:
        """The similarities by tiles small enough for a core's cache. Pairs of a block with itself are those with the
        smaller item on the left; unlike blocks have no item in common. A tile is gone with the next one."""
        buffer = np.empty(min(ROWS, len(self.a)) * min(COLUMNS, len(self.b)))
        for left in range(0, len(self.b), COLUMNS):
            columns = slice(left, min(left + COLUMNS, len(self.b)))
            turned = self.b[columns].T
            for top in range(0, min(len(self.a), columns.stop) if self.own else len(self.a), ROWS):
                rows = slice(top, min(top + ROWS, len(self.a)))
                sims = buffer[: (rows.stop - top) * (columns.stop - left)].reshape(rows.stop - top, -1)
                with np.errstate(invalid="ignore", over="ignore"):
                    np.matmul(self.a[rows], turned, out=sims)
                if not self.finite:
                    sims[np.isnan(sims)] = 1.0  # as the functions of Spark and SQL order it
                np.clip(sims, 0.0, 1.0, out=sims)
                if not self.alike:  # vectors of unlike sizes have no product
                    sims[self.a_size[rows, None] != self.b_size[columns]] = 0.0
                whole = not self.own or self.i[rows.stop - 1] < self.j[left]
                yield _Tile(rows, columns, sims, None if whole else self.less(rows, columns))

    def less(self, rows: slice, columns: slice) -> np.ndarray:
        """Whether the smaller item is that of the row."""
        return self.i[rows, None] < self.j[columns]

    def pairs(self, tile: _Tile, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The smaller and the larger items at places of the tile."""
        x, y = tile.places(at)
        swap = self.i[x] > self.j[y]
        every, n = pa.concat_arrays([self.left, self.right]), len(self.left)
        return every.take(pa.array(np.where(swap, y + n, x))), every.take(pa.array(np.where(swap, x, y + n)))


class _Tile:
    """Some rows and columns of a cell, the similarities there, and which of them are pairs (None: all)."""

    def __init__(self, rows: slice, columns: slice, sims: np.ndarray, keep: np.ndarray | None):
        self.rows, self.columns, self.sims, self.keep = rows, columns, sims, keep

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.sims.shape[1]
        return at // width + self.rows.start, at % width + self.columns.start

    def flat(self) -> np.ndarray:
        """Similarities of the pairs."""
        return self.sims[self.keep] if self.keep is not None else self.sims.ravel()

    def near(self, first: int, last: int) -> np.ndarray:
        """Which pairs may be between two similarities, given as whole numbers from the top; none between is left out."""
        some = self.sims >= (ONE - last - 1) / ONE
        some &= self.sims <= (ONE - first + 1) / ONE
        if self.keep is not None:
            some &= self.keep
        return some


def _ordered(items: pa.Array, rank: np.ndarray, vectors: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Items, their ranks, vectors and sizes in the order of items."""
    order = np.argsort(rank, kind="stable")
    unit, size = _unit(vectors)
    return items.take(pa.array(order)), rank[order], unit[order], size[order]


def _down(sims: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Similarities as whole numbers from the top, to nine places."""
    out = np.multiply(sims, ONE, out=out)
    np.rint(out, out=out)
    return np.subtract(ONE, out, out=out)


def _half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Numbers from 0 to 1 rounded half up by their shortest decimal form, which Spark does row by row."""
    scaled = x * 10.0**places
    whole = np.floor(scaled)
    rest = scaled - whole
    whole += rest >= 0.5
    rest -= 0.5
    near = np.flatnonzero(np.abs(rest) < 1e-6)  # the product may have hidden on which side
    if len(near):
        values, which = np.unique(x[near], return_inverse=True)
        whole[near] = np.array([int(Decimal(repr(v)).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP)) for v in values.tolist()], float)[which]
    return whole / 10.0**places


class Cosines:
    """Pairs i < j of the items of each cohort. Rows without a cohort or an item have none."""

    def __init__(self, items: DataFrame, cohort: str, item: str, vector: str, most: int = MOST_ITEMS):
        kind = items.schema[vector].dataType.simpleString()
        v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
        self.rows = items.select(F.col(cohort).alias("cohort"), F.col(item).alias("item"), v.alias("v"))
        self.cohort, self.item = (self.rows.schema[c].dataType.simpleString() for c in ("cohort", "item"))
        self.most, self._stored = most, None

    def _cells(self, more: DataFrame | None = None) -> DataFrame:
        """cohort, x, y, left, right and the columns of `more` (by cohort): the cells, and the names of their two blocks. Blocks are
        written once, each in a file."""
        spark = self.rows.sparkSession
        if self._stored is None:
            known = self.rows.filter("cohort is not null and item is not null")
            width = 4 if known.schema["v"].dataType.simpleString() == "array<float>" else 8
            fits = F.greatest(F.lit(min(LEAST_ITEMS, self.most)), F.least(F.lit(self.most), F.floor(BLOCK_BYTES / (width * F.greatest(F.lit(1), F.max(F.size("v")))))))
            sizes = known.groupBy("cohort").agg(F.ceil(F.count(F.lit(1)) / fits).cast("int").alias("blocks"))
            placed = known.join(sizes, "cohort").withColumn("own", F.expr("cast(pmod(xxhash64(item), blocks) as int)"))
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a batch is a few blocks
            held = placed.groupBy("cohort", "own").agg(F.collect_list(F.struct("item", "v")).alias("held"))
            self._folder, path = shared.new_folder(spark, "block-files"), shared.new_folder(spark, "blocks")
            files = shared.Batches(self._folder)

            def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    names = [files.write(batch.slice(k, 1).select(["held"])) for k in range(len(batch))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string())], names=["cohort", "own", "file"])

            listed = held.mapInArrow(kept, f"cohort {self.cohort}, own int, file string")
            listed.write.parquet(path)
            self._stored = spark.read.schema(listed.schema).parquet(path)
        one, two = (self._stored.select("cohort", F.col("own").alias(at), F.col("file").alias(side)) for at, side in (("x", "left"), ("y", "right")))
        cells = one.join(two, "cohort").filter("x <= y").select("cohort", "x", "y", "left", "right")
        cells = cells if more is None else cells.join(more, "cohort")
        # few bytes are much work here, so tasks are not joined for their bytes
        return cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cohort", "x", "y").sortWithinPartitions("cohort", "x", "y")

    def _map(self, cells: DataFrame, each: Callable, schema: str) -> DataFrame:
        """`each` (cell, further columns) over all cells; it gives out lists of columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    x, y, left, right = (batch.column(c)[k].as_py() for c in (1, 2, 3, 4))
                    cell = _Cell(files.read(left).column(0), files.read(right).column(0) if x != y else None)
                    more = [c[k].as_py() for c in batch.columns[5:]]
                    for columns in each(cell, *more):
                        n = len(columns[0])
                        if n:
                            of = batch.column(0).take(pa.array(np.full(n, k)))
                            yield pa.RecordBatch.from_arrays([of, *(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns)], names=names)

        files = shared.Batches(self._folder)
        names = [c.strip().split(" ")[0] for c in f"cohort {self.cohort}, {schema}".split(", ")]
        return cells.mapInArrow(run, f"cohort {self.cohort}, {schema}")

    def pairs(self, places: int | None = None) -> DataFrame:
        """cohort, i, j, sim: a row for each pair; `sim` to so many places if given, as Spark's `round`."""

        def each(cell: _Cell) -> Iterator[list]:
            for tile in cell.tiles():
                at = np.flatnonzero(tile.keep) if tile.keep is not None else np.arange(tile.sims.size)
                sims = tile.sims.ravel()[at]
                yield [*cell.pairs(tile, at), sims if places is None else _half_up(sims, places)]

        return self._map(self._cells(), each, f"i {self.item}, j {self.item}, sim double")

    def stats(self, sizes: DataFrame | None = None) -> DataFrame:
        """As `vectors.pair_stats`, from the moments of cells."""

        def each(cell: _Cell) -> Iterator[list]:
            parts = []
            for tile in cell.tiles():
                s = tile.flat()
                if len(s):
                    mean, low, high = s.mean(), s.min(), s.max()
                    s -= mean
                    parts.append((len(s), mean, np.dot(s, s), low, high))
            if parts:
                n, mean, m2, low, high = map(np.array, zip(*parts, strict=True))
                middle = np.dot(n, mean) / n.sum()
                yield [np.array([c]) for c in (n.sum(), middle, m2.sum() + np.dot(n, np.square(mean - middle)), low.min(), high.max())]

        from . import vectors

        parts = self._map(self._cells(), each, "n long, mean double, m2 double, low double, high double")
        mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
        m2 = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) - F.sum(F.col("n") * F.col("mean")) * mean
        deviation = F.sqrt(F.greatest(F.lit(0.0), m2 / F.sum("n")))
        out = parts.groupBy("cohort").agg(F.sum("n").alias("n_pairs"), mean.alias("mean_sim"), deviation.alias("std_sim"), F.min("low").alias("min_sim"), F.max("high").alias("max_sim"))
        return out if sizes is None else vectors.with_range(out, sizes)

    def per_item(self) -> DataFrame:
        """cohort, item, avg_similarity to all other items; 0 for a single item."""

        def each(cell: _Cell) -> Iterator[list]:
            rows, row_n = np.zeros(len(cell.a)), np.zeros(len(cell.a), np.int64)
            columns, column_n = np.zeros(len(cell.b)), np.zeros(len(cell.b), np.int64)
            ones = np.ones(max(ROWS, COLUMNS))
            for tile in cell.tiles():
                sims, keep = tile.sims, tile.keep
                if keep is not None:
                    sims *= keep
                rows[tile.rows] += sims @ ones[: sims.shape[1]]
                columns[tile.columns] += ones[: len(sims)] @ sims
                row_n[tile.rows] += keep.sum(axis=1) if keep is not None else sims.shape[1]
                column_n[tile.columns] += keep.sum(axis=0) if keep is not None else len(sims)
            yield [cell.left, rows, row_n]
            yield [cell.right, columns, column_n]

        sums = self._map(self._cells(), each, f"item {self.item}, total double, n long").groupBy("cohort", "item").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        mean = sums.filter("n > 0").select("cohort", "item", (F.col("total") / F.col("n")).alias("avg_similarity"))
        return self.rows.select("cohort", "item").join(mean, ["cohort", "item"], "left").withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0)))

    def _counted(self, cells: DataFrame, each: Callable, keys: str) -> DataFrame:
        """Pairs per cohort and key."""
        names = [c.split(" ")[0] for c in keys.split(", ")]
        return self._map(cells, each, f"{keys}, held long").groupBy("cohort", *names).agg(F.sum("held").alias("held"))

    def levels(self, n: int | None = None) -> DataFrame:
        """As `vectors.levels`: cohort, band, place, i, j, sim.

        A band is the pairs between two places in the order of similarity, i and j. The first and the last place of
        each band are looked for by counts: per bin of similarity, then per similarity (to nine places) in the bins found,
        then per smaller item at the similarities found, which leaves as many pairs as there are items beyond either bound. Only the pairs
        between the bounds are given out and sorted, however many have equal similarities.
        """
        from . import vectors

        spark = self.rows.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            path = shared.new_folder(spark, name)
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        def per_bin(cell: _Cell) -> Iterator[list]:
            held, work, whole = np.zeros(BINS, np.int64), np.empty(ROWS * COLUMNS), np.empty(ROWS * COLUMNS, np.int64)
            for tile in cell.tiles():
                s = tile.flat()
                down = _down(s, work[: len(s)])
                down /= BIN  # a power of two
                np.copyto(whole[: len(s)], down, casting="unsafe")
                held += np.bincount(whole[: len(s)], minlength=BINS)
            at = np.flatnonzero(held)
            yield [at, held[at]]

        def per_value(cell: _Cell, wanted: list[int]) -> Iterator[list]:
            held = np.zeros((len(wanted), BIN), np.int64)
            for tile in cell.tiles():
                for k, found in enumerate(wanted):
                    some = tile.near(found * BIN, (found + 1) * BIN - 1)
                    if found == BINS - 1:  # zeros may be most of all
                        none = tile.sims == 0
                        none &= some
                        held[k, ONE - found * BIN] += np.count_nonzero(none)
                        some ^= none
                    down = _down(tile.sims[some])
                    held[k] += np.bincount(down[(down >= found * BIN) & (down < (found + 1) * BIN)].astype(np.int64) - found * BIN, minlength=BIN) if len(down) else 0
            k, at = np.nonzero(held)
            yield [np.array(wanted, np.int64)[k] * BIN + at, held[k, at]]

        def per_smaller(cell: _Cell, wanted: list[int]) -> Iterator[list]:
            every = pa.concat_arrays([cell.left, cell.right])
            held = np.zeros((len(wanted), len(every)), np.int64)
            rows, columns = held[:, : len(cell.left)], held[:, len(cell.left) :]
            for tile in cell.tiles():
                for k, found in enumerate(wanted):
                    some = tile.near(found, found)
                    hits = np.count_nonzero(some)
                    if hits * 32 < some.size:
                        at = np.flatnonzero(some)
                        x, y = tile.places(at[_down(tile.sims.ravel()[at]) == found])
                        low = cell.i[x] < cell.j[y]
                        np.add.at(rows[k], x[low], 1)
                        np.add.at(columns[k], y[~low], 1)
                    else:
                        some &= _down(tile.sims) == found
                        low = cell.less(tile.rows, tile.columns)
                        rows[k, tile.rows] += np.count_nonzero(some & low, axis=1)
                        columns[k, tile.columns] += np.count_nonzero(some & ~low, axis=0)
            k, at = np.nonzero(held)
            yield [np.array(wanted, np.int64)[k], every.take(pa.array(at)), held[k, at]]

        def located(targets: DataFrame, counts: DataFrame, key: str, within: list[str]) -> DataFrame:
            """Targets (cohort, edge, offset) with the key that holds their offset, which then counts from its begin."""
            w = Window.partitionBy("cohort", *within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.withColumn("before", F.coalesce(F.sum("held").over(w), F.lit(0)))
            found = targets.join(counts, ["cohort", *within]).filter((F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("held")))
            return found.select(*targets.columns, key, "before").withColumn("offset", F.col("offset") - F.col("before")).drop("before")

        def asked(targets: DataFrame, key: str) -> DataFrame:
            return self._cells(targets.groupBy("cohort").agg(F.array_sort(F.collect_set(key)).alias("wanted")))

        bins = stored(self._counted(self._cells(), per_bin, "bin long"), "bins")
        total = bins.groupBy("cohort").agg(F.sum("held").alias("pairs"))
        size = F.lit(n) if n is not None else F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long")
        total = total.withColumn("size", F.least("pairs", size))
        starts = {"top": F.lit(0), "middle": F.floor(F.col("pairs") / 2), "bottom": F.col("pairs") - F.col("size")}
        edges = [F.struct(F.lit(b).alias("band"), F.lit(e).alias("edge"), (s if e == "first" else F.least(s + F.col("size"), F.col("pairs")) - 1).cast("long").alias("offset")) for b, s in starts.items() for e in ("first", "last")]
        targets = total.select("cohort", F.explode(F.array(*edges)).alias("t")).select("cohort", "t.*").filter("offset >= 0")
        targets = stored(located(targets, bins, "bin", []), "targets")
        values = self._counted(asked(targets, "bin"), per_value, "down long").withColumn("bin", F.floor(F.col("down") / BIN))
        targets = stored(located(targets, values, "down", ["bin"]), "targets")
        smaller = self._counted(asked(targets, "down"), per_smaller, f"down long, i {self.item}")
        targets = stored(located(targets, smaller, "i", ["down"]), "targets")

        def between(cell: _Cell, bounds: list[dict]) -> Iterator[list]:
            # an item's place against the bounds: -1 before, 0 at it, 1 behind
            limits = [[[_side(items, b[e]) for e in ("first_i", "last_i")] for items in (cell.left, cell.right)] for b in bounds]
            for tile in cell.tiles():
                for b, ((left_first, left_last), (right_first, right_last)) in zip(bounds, limits, strict=True):
                    one = b["first_down"] == b["last_down"]
                    if one and not (left_first[tile.rows].max() >= 0 and right_first[tile.columns].max() >= 0 and min(left_last[tile.rows].min(), right_last[tile.columns].min()) <= 0):
                        continue  # all of one similarity, and no smaller item between the bounds
                    at = np.flatnonzero(tile.near(b["first_down"], b["last_down"]))
                    if not len(at):
                        continue
                    of = _down(tile.sims.ravel()[at])
                    x, y = tile.places(at)
                    low = cell.i[x] < cell.j[y]
                    first, last = np.where(low, left_first[x], right_first[y]), np.where(low, left_last[x], right_last[y])
                    some = (of >= b["first_down"]) & (of <= b["last_down"])
                    some &= ~((of == b["first_down"]) & (first < 0)) & ~((of == b["last_down"]) & (last > 0))
                    at, of = at[some], of[some]
                    i, j = cell.pairs(tile, at)
                    yield [pa.array([b["band"]] * len(at), pa.string()), of.astype(np.int64), i, j, tile.sims.ravel()[at]]

        side = lambda e: F.max(F.when(F.col("edge") == e, F.struct("down", "i", "offset")))
        bounds = stored(targets.groupBy("cohort", "band").agg(side("first").alias("f"), side("last").alias("l")).select("cohort", "band", F.col("f.down").alias("first_down"), F.col("f.i").alias("first_i"), F.col("l.down").alias("last_down"), F.col("l.i").alias("last_i"), F.col("f.offset").alias("skip")), "bounds")
        listed = bounds.groupBy("cohort").agg(F.collect_list(F.struct("band", "first_down", "first_i", "last_down", "last_i")).alias("bounds"))
        found = self._map(self._cells(listed), between, f"band string, down long, i {self.item}, j {self.item}, sim double")
        found = stored(found, "between")  # the sort by ranges samples it, which would be all products again
        r = vectors.placed(found, ("cohort", "band"), ["down", "i", "j"])
        sizes = total.select("cohort", "size", "pairs", F.explode(F.map_from_arrays(F.array(*map(F.lit, BANDS)), F.array(*[s.cast("long") for s in starts.values()]))).alias("band", "start"))
        r = r.join(bounds.select("cohort", "band", "skip"), ["cohort", "band"]).join(sizes, ["cohort", "band"]).withColumn("place", F.col("place") - F.col("skip"))
        return r.filter((F.col("place") >= 0) & (F.col("place") < F.col("size"))).select("cohort", "band", F.col("place").cast("long").alias("place"), "i", "j", "sim")


def _side(items: pa.Array, bound) -> np.ndarray:
    """Of each item whether it comes before (-1), is (0) or comes after (1) the bound."""
    value = pa.scalar(bound, items.type)
    return pc.greater(items, value).to_numpy(zero_copy_only=False).astype(int) - pc.less(items, value).to_numpy(zero_copy_only=False).astype(int)
