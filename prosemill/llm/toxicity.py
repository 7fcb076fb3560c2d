"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, pairs of neighbours and pairs with one or two words between,
hashed into 2**`BITS` places; each feature that a text has, however often, weighs `SCALE` / words**`POWER`,
so a long text does not hide an insult among its words. Training is online with
per-coordinate rates; L1 keeps few weights, so the model that every task gets is at most 2**`BITS`
numbers, whatever it was trained on.

The model is fitted on the labelled rows that may be learnt from, at most `TRAIN_ROWS` of them (those
with the smallest hashes of their identifiers), in one task that streams them `EPOCHS` times.
Scoring covers every whole text. Labels, language, source and identifier are no inputs of a score.

Defined results: null and empty texts get the score of the bias alone; labels that are null are not
learnt from; without any label all scores are 0.5 before the threshold; repeated rows get equal scores; an empty
table gives an empty result; other columns are kept as they are, and a score under the name of one of them is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import U64, blocks, mix, word_hashes, words
from .common import Scratch, table

BITS, SCALE, POWER, TRAIN_ROWS, EPOCHS = 18, 4.0, 0.25, 20_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 1.0
THRESHOLD = 0.3

#: letters and digits of ASCII (either case) and all bytes of other characters make words
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: distance between the two words of a pair, and the salt of its features
_PAIRS = ((1, 2), (2, 3), (3, 4))


def features(texts: pa.Array):
    """For blocks of rows: (first row, places of all features, row of each within the block, words per row)."""
    for lo, hi, data, offsets in blocks(texts):
        data = _LOWER[data]
        starts, ends, cuts = words(data, offsets, _GAP)
        h = word_hashes(data, starts, ends)
        count = np.diff(cuts)
        row = np.repeat(np.arange(hi - lo), count)
        places, rows = [mix(h + U64(1))], [row]
        for gap, salt in _PAIRS:
            same = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, bool)
            a, b = h[: len(same)][same], h[gap:][same] if len(same) else h[:0]
            places.append(mix(a * U64(3) + b * U64(5) + U64(salt)))
            rows.append(row[: len(same)][same])
        yield lo, (np.concatenate(places) & U64((1 << BITS) - 1)).astype(np.int64), np.concatenate(rows), count


def _unit(n_words: np.ndarray | int) -> np.ndarray:
    """What one feature weighs in texts of so many words."""
    return SCALE / np.maximum(n_words, 1) ** POWER


def _weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows (label, places, n_words); yields the nonzero weights, bias as place -1."""
    z, n, zb, nb, seen = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0
    for batch in batches:
        for label, at, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            seen += 1
            at = np.asarray(at.values.to_numpy(zero_copy_only=False), np.int64)
            x = np.full(len(at), _unit(size))
            w = _weight(z[at], n[at])
            wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            error = 1 / (1 + np.exp(-np.clip(w @ x + wb, -30, 30))) - label
            g = error * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA * wb
            nb += error * error
    if seen:
        w = _weight(z, n)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], -zb / ((BETA + np.sqrt(nb)) / ALPHA)))], names=["place", "weight"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> np.ndarray:
    """Dense weights, the bias last. `may_learn` is a condition over the column `id`."""
    scratch = Scratch(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(may_learn & F.col("id").isNotNull() & F.col("label").isNotNull())
    order = F.xxhash64(F.lit(7), F.col("id"))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("place", order).orderBy("place", "id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("place", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = [], []
            for _, places, row, n_words in features(batch.column(2)):
                for i, n in enumerate(np.split(places[np.argsort(row, kind="stable")], np.cumsum(np.bincount(row, minlength=len(n_words)))[:-1])):
                    at.append(np.unique(n).astype(np.int32))
                    size.append(int(n_words[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(size, pa.int64())], names=["place", "label", "at", "size"])

    ready = scratch.write(rows.mapInArrow(extract, "place long, label int, at array<int>, size long"), "features")
    passes = ready.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(EPOCHS)])))
    stream = passes.repartition(1).sortWithinPartitions("pass", "place", "size").select("label", "at", "size")
    weights = np.zeros((1 << BITS) + 1)
    for place, weight in stream.mapInArrow(_fit, "place int, weight double").collect():  # at most 2**BITS + 1 rows
        weights[place] = weight
    scratch.drop("features")
    return weights


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function text -> score from 0 to 1."""
    places = np.flatnonzero(weights[:-1]).astype(np.int32)
    model = spark.sparkContext.broadcast((places, weights[places], float(weights[-1])))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        places, values, bias = model.value
        dense = np.zeros(1 << BITS)
        dense[places] = values
        out = np.zeros(len(texts))
        for lo, at, row, n_words in features(texts):
            some = np.flatnonzero(dense[at])
            once = np.unique(row[some] << BITS | at[some])
            out[lo : lo + len(n_words)] = np.bincount(once >> BITS, weights=dense[once & ((1 << BITS) - 1)], minlength=len(n_words)) * _unit(n_words)
        return pa.array(1 / (1 + np.exp(-np.clip(out + bias, -30, 30))))

    return score


def fold(id_column: Column) -> Column:
    """crc32 of the identifier as text, modulo 4."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4))


def with_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """`docs` with a column of scores, learnt from the labelled rows outside fold 2."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}")
    weights = train(spark, docs, labels, fold(F.col("id")) != 2)
    return docs.withColumn(name, scorer(spark, weights)(F.col("text").cast("string")))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their columns; all rows, if nothing was learnt."""
    weights = train(spark, docs, labels, fold(F.col("id")) != 2)
    return docs.filter(scorer(spark, weights)(F.col("text").cast("string")) < THRESHOLD) if weights.any() else docs


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_score(spark, docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
