"""Quality: a generalised additive model with pairwise interactions over shapes of a text.

A text is described by `NAMES`, numbers that do not depend on its language: shares of signs, digits and capitals,
lengths of words and lines, repeated words, lines and neighbours. Each number falls into one of at most `BINS` bins.
The model is a sum of lookup tables, one per number and one per chosen pair of numbers, of the logarithm of the odds of
label 1. Tables are learnt by cyclic boosting: in each round every table in turn gets a small step of a shallow tree, of
up to three leaves over its bins or of four quadrants over a pair's, fitted to what the sum still lacks. Pairs are chosen after the
single tables, by how much the best four quadrants would gain on the rest. A score is one lookup per table.

The model is fitted on the labelled rows that may be learnt from, at most `TRAIN_ROWS` of them (those with the smallest
hashes of their identifiers), in one task; the tables, at most (numbers + `PAIRS` x BINS) x BINS entries, are broadcast.
Scoring covers every whole text. Labels, language, source and identifier are no inputs of a score.

Defined results: null and empty texts have all numbers 0 and a score by the tables; null labels are not learnt from, and
of conflicting ones the higher counts; of rows with one identifier the smallest text is learnt from; without labels all
scores are 0.5; repeated rows get equal scores; an empty table gives an empty result; a very long text is a block
of its own; other columns are kept as they are, and a score under the name of one of them is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, blocks, mix, prefix, span_hash, word_hashes, words
from .common import Scratch, table

TRAIN_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_ROWS = 250, 120, 0.08, 2.0, 8
THRESHOLD = 0.3

_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_UPPER, _LOWER, _DIGIT, _HIGH = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B], _LOWER[0x61:0x7B], _DIGIT[0x30:0x3A], _HIGH[0x80:] = True, True, True, True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?'\"()-"]] = True
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP)
_SIGN[[0x20, *range(0x09, 0x0E)]] = False
_BYTE_CLASSES = {"signs": _SIGN, "stops": _STOP, "digits": _DIGIT, "upper": _UPPER, "high": _HIGH}
for _name, _bytes in {"exclamations": b"!", "bars": b"|", "dots": b".", "commas": b",", "brackets": b"<>{}[]", "lines": b"\n"}.items():
    _BYTE_CLASSES[_name] = np.isin(np.arange(256), list(_bytes))
NAMES = [
    *_BYTE_CLASSES, "words", "word_length", "length_spread", "longest_word", "short_words", "signed_ends", "capital_words", "digit_words",
    "same_neighbour", "different_words", "top_word", "different_pairs", "line_words", "line_spread", "same_lines", "ended_lines",
]


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def _different(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: different keys, and how often the most frequent one stands."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))) if len(k) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, r[first], np.diff(np.append(first, len(k))))
    return np.bincount(r[first], minlength=n), most


def describe(texts: pa.Array) -> np.ndarray:
    """A row of numbers, as `NAMES` lists them, per text."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, hi, data, offsets in blocks(texts):
        n, size = hi - lo, np.diff(offsets)
        columns = []
        for held in _BYTE_CLASSES.values():
            total = np.concatenate(([0], np.cumsum(held[data])))
            columns.append(_share(total[offsets[1:]] - total[offsets[:-1]], size))
        starts, ends, cuts = words(data, offsets)
        count, length = np.diff(cuts), ends - starts
        row = np.repeat(np.arange(n), count)
        per = lambda x: np.bincount(row, weights=x, minlength=n)
        h = word_hashes(data, starts, ends)
        first, last = data[starts], data[ends - 1] if len(ends) else data[:0]
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        mean = _share(per(length), count)
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        next_same = np.flatnonzero(row[1:] == row[:-1])
        pair_row, pair = row[next_same], mix(h[next_same] * U64(3) + h[next_same + 1] * U64(5))
        kinds, top = _different(h, row, n)
        pairs, _ = _different(pair, pair_row, n)
        line_start, line_end, line_cuts = words(data, offsets, _LINE)
        n_lines = np.diff(line_cuts)
        line_row = np.repeat(np.arange(n), n_lines)
        line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
        lines, _ = _different(span_hash(prefix(data.astype(U64) + U64(1)), line_start, line_end), line_row, n)
        line_mean = _share(np.bincount(line_row, weights=line_words, minlength=n), n_lines)
        line_square = _share(np.bincount(line_row, weights=line_words.astype(float) ** 2, minlength=n), n_lines)
        ended = np.bincount(line_row, weights=_STOP[data[line_end - 1]] if len(line_end) else None, minlength=n)
        columns += [
            count, mean, np.sqrt(np.maximum(_share(per(length.astype(float) ** 2), count) - mean**2, 0)), longest, _share(per(length <= 3), count), _share(per(_SIGN[last]), count),
            _share(per(_UPPER[first]), count), _share(per(digits[ends] > digits[starts]), count), _share(np.bincount(row[1:][next_same], weights=h[next_same] == h[next_same + 1], minlength=n), count),
            _share(kinds, count), _share(top, count), _share(pairs, count - 1), line_mean, np.sqrt(np.maximum(line_square - line_mean**2, 0)), 1 - _share(lines, n_lines), _share(ended, n_lines),
        ]
        part = np.stack(columns, axis=1)
        part[count == 0] = 0
        out[lo:hi] = part
    return out


@dataclass
class Model:
    """Edges of the bins per number, a table per number, and (number, number, table) per pair."""

    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.bias)
        for b, t in zip(at, self.single, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[_coarse(at[i], len(self.edges[i]) + 1), _coarse(at[j], len(self.edges[j]) + 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def _coarse(at: np.ndarray, n: int) -> np.ndarray:
    """Bins of a pair's table: neighbouring bins together."""
    return at * PAIR_BINS // max(n, PAIR_BINS)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    left = [np.cumsum(x)[:-1] for x in (g, h, n)]
    right = [x.sum() - part for x, part in zip((g, h, n), left, strict=True)]
    gain = np.where((left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS), _gain(left[0], left[1]) + _gain(right[0], right[1]) - _gain(g.sum(), h.sum()), -1.0)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over a table's bins: each bin's step."""
    cuts = [0, len(g)]
    for _ in range(2):
        found = [(*_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        gain, at, start = max(found)
        if gain <= 0:
            break
        cuts = sorted([*cuts, start + at])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best four quadrants of a pair's table."""
    corner = [np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n)]
    parts = [(c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]) for c in corner]
    gain = sum(_gain(a, b) for a, b in zip(parts[0], parts[1], strict=True)) - _gain(g.sum(), h.sum())
    gain = np.where(np.minimum.reduce(parts[2]) >= LEAST_ROWS, gain, -1.0)
    x, y = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    if gain[x, y] <= 0:
        return -1.0, out
    for k, (rows, cols) in enumerate(((slice(0, x + 1), slice(0, y + 1)), (slice(0, x + 1), slice(y + 1, None)), (slice(x + 1, None), slice(0, y + 1)), (slice(x + 1, None), slice(y + 1, None)))):
        out[rows, cols] = parts[0][k][x, y] / (parts[1][k][x, y] + RIDGE)
    return float(gain[x, y]), out


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Cyclic boosting of the single tables, choice of the pairs, cyclic boosting of the pairs' tables."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, i], quantiles)) for i in range(x.shape[1])]
    edges = [e[e > x[:, i].min()] for i, e in enumerate(edges)]
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], float(np.log(rate / (1 - rate))))
    at, odds = model.bins(x), np.full(len(x), model.bias)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return label - p, p * (1 - p)

    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(at, model.single, strict=True)]
    for _ in range(ROUNDS):
        for b, t, n in zip(at, model.single, counts, strict=True):
            g, h = rest()
            step = RATE * _tree(np.bincount(b, weights=g, minlength=len(t)), np.bincount(b, weights=h, minlength=len(t)), n)
            t += step
            odds += step[b]

    wide = [_coarse(b, len(e) + 1) for b, e in zip(at, edges, strict=True)]
    square = PAIR_BINS * PAIR_BINS
    grid = lambda cell, w: np.bincount(cell, weights=w, minlength=square).reshape(PAIR_BINS, PAIR_BINS)
    g, h = rest()
    found = []
    for i in range(len(wide)):
        for j in range(i):
            cell = wide[i] * PAIR_BINS + wide[j]
            found.append((_quadrants(grid(cell, g), grid(cell, h), grid(cell, None))[0], i, j))
    chosen = [(i, j, wide[i] * PAIR_BINS + wide[j]) for gain, i, j in sorted(found, key=lambda f: (-f[0], f[1:]))[:PAIRS] if gain > 0]
    tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in chosen]
    for _ in range(PAIR_ROUNDS):
        for (_, _, cell), t in zip(chosen, tables, strict=True):
            g, h = rest()
            step = RATE * _quadrants(grid(cell, g), grid(cell, h), grid(cell, None))[1]
            t += step
            odds += step.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j, _), t in zip(chosen, tables, strict=True)]
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The fitted model, or None without labels. `may_learn` is a condition over the column `id`."""
    scratch = Scratch(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(may_learn & F.col("id").isNotNull() & F.col("label").isNotNull())
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64(F.lit(7), F.col("id"))).orderBy("place", "id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column(3))
            hashes = pa.array([hash_of(t) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], hashes, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))], names=["id", "place", "label", "text_hash", "x"])

    def hash_of(text: str | None) -> int:
        import hashlib

        return int.from_bytes(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    kind = docs.schema[id_col].dataType.simpleString()
    ready = scratch.write(rows.select("id", "place", "label", "text").mapInArrow(described, f"id {kind}, place long, label int, text_hash long, x array<double>"), "numbers")
    one = ready.groupBy("id").agg(F.min_by(F.struct("place", "label", "x"), "text_hash").alias("r")).select("id", "r.*")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most TRAIN_ROWS rows of numbers
        label = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0)
        if not len(label):
            return
        x = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, len(NAMES))
        m = fit(x, label.astype(float))
        rows = [("bias", 0, 0, [m.bias])]
        rows += [("edges", i, 0, e.tolist()) for i, e in enumerate(m.edges)] + [("single", i, 0, t.tolist()) for i, t in enumerate(m.single)]
        rows += [("pair", i, j, t.ravel().tolist()) for i, j, t in m.pairs]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["part", "i", "j", "numbers"])

    tables = one.repartition(1).sortWithinPartitions("place", "id").select("label", "x").mapInArrow(fitted, "part string, i int, j int, numbers array<double>").collect()  # one row per table
    scratch.drop("numbers")
    if not tables:
        return None
    part = lambda name: [np.array(r.numbers) for r in sorted((t for t in tables if t.part == name), key=lambda t: t.i)]
    return Model(part("edges"), part("single"), [(t.i, t.j, np.array(t.numbers).reshape(PAIR_BINS, PAIR_BINS)) for t in tables if t.part == "pair"], float(part("bias")[0][0]))


def scorer(spark: SparkSession, model: Model | None):
    """A column function text -> score from 0 to 1."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.full(len(texts), 0.5) if held.value is None else held.value.score(describe(texts)))

    return score


def fold(id_column: Column) -> Column:
    """crc32 of the identifier as text, modulo 5."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5))


def with_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """`docs` with a column of scores, learnt from the labelled rows outside fold 0."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}")
    model = train(spark, docs, labels, fold(F.col("id")) != 0)
    return docs.withColumn(name, scorer(spark, model)(F.col("text").cast("string")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_score(spark, docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
