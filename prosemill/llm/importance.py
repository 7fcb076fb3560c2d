"""Target-distribution importance resampling over an integer word dictionary.

A corpus is resampled towards a target: hashed n-gram counts of both give each bucket a gain, the logarithm of how much
likelier the target is to fill it; a document weighs the sum of the gains of its n-grams, and the highest sums of weight
and Gumbel noise are drawn, without replacement.

Texts are read in blocks of a bounded number of bytes. A block lists its different words and writes its n-grams as
tuples of places in that list, each different tuple once with its number; documents keep places of tuples. The different
words of all blocks become one dictionary, word to id, and the tuples of all blocks tuples of ids, which are counted per
corpus. Each different tuple is spelled out by the dictionary and hashed once; buckets' counts, and later the tuples'
gains, are joined back by the tuples. So words are never shuffled per occurrence, a frequent word is one row
a block, and only the gains, one number a bucket, are broadcast.

Defined results: null and empty texts have no words and weigh 0; a null identifier draws its noise as the empty one;
repeated rows are rows of their own, with equal weights and, under one identifier, equal noise; ties go to the smaller
identifier, null first, and repeated rows among themselves to the order of the stored rows; empty tables give an empty
result, and without a target every gain is that of missing features; a very long text is a block of its own;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import blocks, words
from .common import ROW_GROUPS, Scratch, table

#: bytes of text in a block
BLOCK = 8 << 20
#: n-grams up to so many words, buckets, seed of the noise, words that a document needs, and per cent drawn
GRAMS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: digits, letters of ASCII and all bytes of other characters make words
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _tuples(ids: np.ndarray, row: np.ndarray, n_words: int, most: int):
    """All runs of 1 to `most` ids within a row: different tuples, flat, and their sizes; place of each
    occurrence, its row."""
    flat, sizes, places, rows = [np.arange(n_words)], [np.ones(n_words, np.int64)], [ids], [row]
    code, total = ids, n_words
    for n in range(2, most + 1):
        m = max(0, len(ids) - n + 1)
        fits = row[:m] == row[n - 1 :] if m else np.zeros(0, bool)
        at = np.flatnonzero(fits)
        # an (n - 1)-gram of the same row begins at each of these places; `code` numbers those by their first place
        _, first, code_n = np.unique(code[:m][at] * max(1, n_words) + ids[at + n - 1], return_index=True, return_inverse=True)
        flat.append(np.stack([ids[at[first] + d] for d in range(n)], axis=1).ravel())
        sizes.append(np.full(len(first), n))
        places.append(code_n + total)
        rows.append(row[at])
        total += len(first)
        code = np.full(len(ids), -1)
        code[at] = code_n
    return np.concatenate(flat), np.concatenate(sizes), np.concatenate(places), np.concatenate(rows)


def encode(docs: DataFrame, id_col: str, text_col: str, grams: int = GRAMS) -> DataFrame:
    """One row per block: its words; its tuples (places of words) with their numbers; per document id, n_words,
    n_features and n_places, and one after the other the documents' places of tuples with how often each stands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                data = _LOWER[data]
                starts, ends, cuts = words(data, offsets, _GAP)
                count = np.diff(cuts)
                bounds = pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64).tobytes())
                said = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(data[~_GAP[data]].tobytes())]).dictionary_encode()
                ids = said.indices.to_numpy().astype(np.int64)
                flat, sizes, place, row = _tuples(ids, np.repeat(np.arange(hi - lo), count), len(said.dictionary), grams)
                once, times = np.unique(row * max(1, len(sizes)) + place, return_counts=True)
                owner, place = once // max(1, len(sizes)), once % max(1, len(sizes))
                tuples = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32)))
                held = [
                    said.dictionary.cast(pa.string()), tuples, pa.array(np.bincount(place, weights=times, minlength=len(sizes)).astype(np.int64)),
                    batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(np.bincount(owner, weights=times, minlength=hi - lo).astype(np.int64)),
                    pa.array(np.bincount(owner, minlength=hi - lo)), pa.array(place.astype(np.int32)), pa.array(times.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held], names=names)

    names = ["words", "tuples", "numbers", "id", "n_words", "n_features", "n_places", "place", "times"]
    schema = f"words array<string>, tuples array<array<int>>, numbers array<long>, id array<{kind}>, n_words array<long>, n_features array<long>, n_places array<long>, place array<int>, times array<int>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(listed, schema)


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def _ordered(df: DataFrame, place: str, value: str) -> DataFrame:
    """block, and the values of a block in order of their places."""
    return df.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(value))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for all buckets, from counts (bucket, s, t) of source and target. One row per bucket."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    s, t = (F.coalesce(c, F.lit(0)).cast("double") + 1.0 for c in ("s", "t"))
    ratio = (t * (F.col("all_s") + buckets)) / (s * (F.col("all_t") + buckets))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    return every.join(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def weigh(spark: SparkSession, source: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Per row of `source`: id, n_words, n_features, weight."""
    scratch = Scratch(spark)
    kind = source.schema[id_col].dataType.simpleString()
    own = encode(source, id_col, text_col, grams).withColumn("target", F.lit(False))
    other = encode(target, target_id, target_text, grams).withColumn("id", F.lit(None).cast(f"array<{kind}>")).withColumn("target", F.lit(True))
    all_blocks = scratch.write(own.unionByName(other).withColumn("block", F.monotonically_increasing_id()), "blocks", **ROW_GROUPS)

    # the first tuples of a block are its single words, in order
    alone = F.posexplode(F.arrays_zip("words", F.slice("numbers", F.lit(1), F.size("words")).alias("number")))
    said = all_blocks.select("block", "target", alone.alias("at", "x")).select("block", "target", "at", F.col("x.words").alias("word"), F.col("x.number").alias("number"))
    dictionary = scratch.write(said.select("word").distinct().withColumn("word_id", F.monotonically_increasing_id()), "dictionary")
    in_ids = said.join(dictionary, "word").select("block", "target", "at", F.array("word_id").alias("tuple"), "number")
    if grams > 1:
        known = _ordered(said.join(dictionary, "word"), "at", "word_id")
        longer = all_blocks.select("block", "target", F.size("words").alias("first"), "tuples", "numbers").join(known, "block")
        longer = longer.withColumn("tuples", F.transform("tuples", lambda t: F.transform(t, lambda i: F.col("word_id")[i])))
        longer = longer.select("block", "target", "first", F.posexplode(F.arrays_zip("tuples", "numbers")).alias("at", "x")).filter("at >= first")
        in_ids = in_ids.unionByName(longer.select("block", "target", "at", F.col("x.tuples").alias("tuple"), F.col("x.numbers").alias("number")))
    tuples = scratch.write(in_ids, "tuples")

    side = lambda is_target: F.sum(F.when(F.col("target") == is_target, F.col("number")).otherwise(0))
    counted = tuples.groupBy("tuple").agg(side(False).alias("s"), side(True).alias("t"))
    counted = scratch.write(counted.withColumn("tuple_id", F.monotonically_increasing_id()), "counted")
    parts = counted.select("tuple_id", F.posexplode("tuple").alias("at", "word_id")).join(dictionary, "word_id")
    spelled = parts.groupBy("tuple_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("gram"))
    hashed = scratch.write(counted.join(spelled, "tuple_id").select("tuple", "s", "t", bucket(F.col("gram"), buckets).alias("bucket")), "hashed")

    per_bucket = scratch.write(gains(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), buckets), "gains")
    gained = hashed.join(F.broadcast(per_bucket), "bucket").select("tuple", "gain")  # one number a bucket
    back = _ordered(tuples.filter(~F.col("target")).select("block", "at", "tuple").join(gained, "tuple"), "at", "gain")
    held = all_blocks.filter(~F.col("target")).select("block", "id", "n_words", "n_features", "n_places", "place", "times").join(back, "block", "left")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, n_words, n_features, *rest = [c.slice(row, 1).flatten() for c in batch.columns]
                n_places, place, times, gain = (x.to_numpy(zero_copy_only=False) for x in rest)
                sums = np.concatenate(([0], np.cumsum(times * gain[place] if len(place) else place)))[np.concatenate(([0], np.cumsum(n_places)))]
                yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(np.diff(sums), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    out = held.select("id", "n_words", "n_features", "n_places", "place", "times", "gain").mapInArrow(summed, f"id {kind}, n_words long, n_features long, weight long")
    out = scratch.write(out, "weighed")
    scratch.drop("blocks", "dictionary", "tuples", "counted", "hashed", "gains")
    return out


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def draw(spark: SparkSession, weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """`weighed` with score and, for the drawn rows, rank from 1. Rows are sorted over the cluster by ranges; ranks
    follow from the number of rows of each range."""
    scratch = Scratch(spark)
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("seq")]
    rows = weighed.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "fits": F.col("n_words") >= least_words, "seq": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.write(rows.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "ordered")
    parts = rows.groupBy("part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("fit").over(Window.partitionBy()) * percent / 100)
    parts = parts.select("part", (before - F.col("first") + 1).alias("shift"), drawn.alias("drawn"))  # one row per partition
    place = F.col("seq") + F.col("shift")
    return rows.join(F.broadcast(parts), "part").select(*weighed.columns, "score", F.when(F.col("fits") & (place <= F.col("drawn")), place).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = draw(spark, weigh(spark, docs, target))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: its table by rule, folded over the bytes of each different word
ORACLE = rf"""
WITH said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
), asked AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), step AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), bytes AS (
  SELECT word, [4294967295::BIGINT] || list_transform(range(0, (length(hex(encode(word))) / 2)::BIGINT), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b
  FROM (SELECT word FROM said UNION SELECT word FROM asked)
), hashed AS (
  SELECT word, (xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS})::INTEGER AS bucket FROM bytes, step
), ours AS (SELECT bucket, count(*) AS s FROM said JOIN hashed USING (word) GROUP BY bucket
), theirs AS (SELECT bucket, count(*) AS t FROM asked JOIN hashed USING (word) GROUP BY bucket
), total AS (SELECT (SELECT count(*) FROM said)::DOUBLE AS all_s, (SELECT count(*) FROM asked)::DOUBLE AS all_t
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM ours FULL JOIN theirs USING (bucket), total
), weighed AS (
  SELECT doc_id, count(word)::BIGINT AS n_features, coalesce(sum(gain), 0)::BIGINT AS weight
  FROM documents LEFT JOIN said USING (doc_id) LEFT JOIN hashed USING (word) LEFT JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weighed
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= ({PERCENT} * (SELECT count(*) FROM weighed WHERE n_features >= {LEAST_WORDS})) // 100 THEN place END AS rank FROM placed
"""
