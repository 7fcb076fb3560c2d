"""TF-IDF with smooth idf and unit rows: fit, transform and sparse cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .vectors import in_blocks


def terms(docs: DataFrame, text: str) -> DataFrame:
    """The different terms of texts."""
    return docs.select(F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).distinct()


def vocabulary(docs: DataFrame, text: str, among: DataFrame | None = None) -> DataFrame:
    """term, df, idf = ln((1 + N) / (1 + df)) + 1; of the terms `among` (term), which tasks can hold, if given."""
    said = docs.select(F.explode(F.array_distinct(X.tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    if among is not None:
        said = said.join(F.broadcast(among), "term", "left_semi")
    counted = said.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    return counted.join(F.broadcast(total)).select("term", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def weights(docs: DataFrame, item: str, text: str, vocab: DataFrame) -> DataFrame:
    """item, term, weight; unknown terms drop out."""
    tf = docs.select(F.col(item).alias("item"), F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocab, "term").select("item", "term", (F.col("tf") * F.col("idf")).alias("w"))
    size = raw.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "item").select("item", "term", (F.col("w") / F.col("size")).alias("weight"))


#: entries of left postings that are multiplied at once
STEP = 1 << 20


class _Left:
    """The left items of a cell as postings: per term the items that have it and their weights."""

    def __init__(self, items: list, terms: list[pa.Array], weights: list[np.ndarray]):
        self.items = pa.array(items)
        flat, owner = pa.concat_arrays(terms), np.repeat(np.arange(len(items)), [len(t) for t in terms])
        self.known = flat.unique()
        codes = pc.index_in(flat, self.known).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate(weights)[order]
        self.count = np.bincount(codes, minlength=len(self.known))
        self.first = np.cumsum(self.count) - self.count

    def dots(self, terms: pa.Array, cuts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Dot products of right items, whose terms are cut at `cuts`, with all left ones: a row each."""
        n, row = len(cuts) - 1, np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        code = pc.fill_null(pc.index_in(terms, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = np.flatnonzero(code >= 0)
        code, row, weights = code[hit], row[hit], weights[hit]
        out = np.zeros(n * len(self.items))
        size = np.cumsum(self.count[code])
        lo = 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP, "right")))
            c, times = code[lo:hi], self.count[code[lo:hi]]
            at = np.repeat(self.first[c] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
            out += np.bincount(np.repeat(row[lo:hi], times) * len(self.items) + self.owner[at], weights=np.repeat(weights[lo:hi], times) * self.weight[at], minlength=len(out))
            lo = hi
        return out.reshape(n, len(self.items))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cohort, x, y, left, item, terms, weights), those of a cell together and its left items first: the dot
    products of each left item with each later right item."""
    last, gathered, left = None, ([], [], []), None
    for batch in batches:
        kind, item_type = batch.schema.field(0).type, batch.schema.field(4).type
        cohort, item = batch.column(0).to_pylist(), batch.column(4)
        cell = list(zip(cohort, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        is_left = batch.column(3).to_pylist()
        cuts = batch.column(5).offsets.to_numpy().astype(np.int64)
        terms, weights = batch.column(5).values, batch.column(6).values.to_numpy(zero_copy_only=False)
        lo, n = 0, len(batch)
        while lo < n:
            hi = lo + 1
            while hi < n and hi - lo < 64 and cell[hi] == cell[lo] and is_left[hi] == is_left[lo]:
                hi += 1
            if cell[lo] != last:
                last, gathered, left = cell[lo], ([], [], []), None
            flat, cut = terms.slice(cuts[lo], cuts[hi] - cuts[lo]), cuts[lo : hi + 1] - cuts[lo]
            if is_left[lo]:
                for i in range(lo, hi):
                    gathered[0].append(item[i].as_py())
                    gathered[1].append(terms.slice(cuts[i], cuts[i + 1] - cuts[i]))
                    gathered[2].append(weights[cuts[i] : cuts[i + 1]])
            elif gathered[0]:
                left = left or _Left(*gathered)
                dots = left.dots(flat, cut, weights[cuts[lo] : cuts[hi]])
                j, i = np.repeat(np.arange(lo, hi), len(left.items)), np.tile(np.arange(len(left.items)), hi - lo)
                first, second = left.items.take(pa.array(i)).cast(item_type), item.take(pa.array(j))
                later = pc.less(first, second)
                held = [first, second, pa.array(dots.ravel())]
                held = [c.filter(later) for c in held]
                yield pa.RecordBatch.from_arrays([pa.array([cohort[lo]] * len(held[0]), kind), *held], names=["cohort", "i", "j", "dot"])
            lo = hi


def pairs(docs: DataFrame, item: str, w: DataFrame, cohort: str | Column = "all") -> DataFrame:
    """cohort, i, j, sim for all i < j; pairs without a common term have 0.

    Items meet in the cells of a grid of blocks, where a term that many of them have is one list of the cell; terms
    are not joined, so a term of all items makes no rows.
    """
    bags = w.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    items = docs.select((F.lit(cohort) if isinstance(cohort, str) else cohort).alias("cohort"), F.col(item).alias("item")).join(bags, "item", "left")
    none = F.array()
    items = items.select("cohort", "item", F.coalesce("terms", none.cast("array<string>")).alias("terms"), F.coalesce("weights", none.cast("array<double>")).alias("weights"))
    placed = in_blocks(items)
    side = lambda left, x, y: placed.select("cohort", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(left).alias("left"), "item", "terms", "weights")
    cells = side(True, "own", "other").unionByName(side(False, "other", "own")).repartition("cohort", "x", "y").sortWithinPartitions("cohort", "x", "y", F.desc("left"))
    kind = items.schema["item"].dataType.simpleString()
    dots = cells.mapInArrow(_cells, f"cohort string, i {kind}, j {kind}, dot double")
    return dots.select("cohort", "i", "j", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))).alias("sim"))
