"""Texts cut into runs of words for counting n-grams: what is shuffled is runs, not every n-gram with all its words.

Of the word pairs of an n-gram the one with the largest hash is its key, so n-grams that follow one another mostly have the same
key and go out as one run of words. Equal n-grams have equal keys and meet in one bucket, whatever runs they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .phrases import _mix

#: bytes of text in a batch, n-grams worked on at once and in a run at most, and bytes of a table's files for one task of the count
BATCH, STEP, LONGEST, TASK = 8 << 20, 1 << 20, 64, 8 << 20
#: bytes of runs that are counted at once
LIMIT = 32 << 20
#: buckets a task of the count has, about
SPREAD = 8


def _words(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, their hashes and rows."""
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    words = lists.flatten()
    coded = words.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return words, known[coded.indices.to_numpy()], row


def _runs(lists: pa.Array, n: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """The keys, words and repeats of the different runs, `STEP` n-grams at a time. Each n-gram of the texts stands in one run."""
    words, key, row = _words(lists)
    if n > 1 and len(key):
        key = _mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + key[1:])
    for lo in range(0, len(words) - n + 1, STEP):
        count = min(STEP, len(words) - n + 1 - lo)
        of = key[lo : lo + count].copy()
        for d in range(1, n - 1):
            np.maximum(of, key[lo + d : lo + d + count], out=of)
        whole = row[lo : lo + count] == row[lo + n - 1 : lo + n - 1 + count]
        new = np.ones(count, bool)
        new[1:] = (of[1:] != of[:-1]) | ~whole[:-1]
        at = np.flatnonzero(whole)
        since = at - np.maximum.accumulate(np.where(new, np.arange(count), 0))[at]
        first = np.flatnonzero(since % LONGEST == 0)
        size = np.diff(np.append(first, len(at))) + n - 1
        cuts = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(at[first] + lo - cuts[:-1], size) + np.arange(cuts[-1])
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(place))), " ").dictionary_encode()
        code = said.indices.to_numpy()
        keys = np.zeros(len(said.dictionary), np.uint64)
        keys[code] = of[at[first]]
        yield keys, said.dictionary, np.bincount(code, minlength=len(keys))


def _packed(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, said, times in _runs(batch.column(0), n):
                bucket = (keys % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((keys, times, bucket))
                bucket, times = bucket[order], times[order]
                first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (times[1:] != times[:-1]))[: len(order)])
                cuts = pa.array(np.append(first, len(order)), pa.int32())
                lists = pc.binary_join(pa.ListArray.from_arrays(cuts, said.take(pa.array(order))), "\n")
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(times[first].astype(np.int64)), lists], names=["bucket", "n", "runs"])

    return run


def _grams(runs: pa.Array, times: np.ndarray, n: int) -> pa.Table:
    """The n-grams of each row's lines of runs, and how often they stand."""
    lists = pc.split_pattern(runs, "\n")
    split = pc.split_pattern(lists.flatten(), " ")
    cuts, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
    count = np.diff(cuts) - n + 1
    first = np.repeat(cuts[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    grams = pc.binary_join_element_wise(*[words.take(pa.array(first + d)) for d in range(n)], " ")
    return pa.table({"g": grams, "n": np.repeat(np.repeat(times, np.diff(lists.offsets.to_numpy())), count)})


def _count(n: int, limit: int = LIMIT):
    """Over rows (bucket, n, runs) in the order of buckets: g, n. Some buckets are counted at once, one of many bytes by shares of its n-grams."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = -(-sum(b.column(2).nbytes for b in held) // limit)
        for share in range(shares):
            some = []
            for b in held:
                grams = _grams(b.column(2), b.column(1).to_numpy(), n)
                if shares > 1:
                    of = pd.util.hash_array(grams.column(0).to_numpy().astype(object), categorize=False) % np.uint64(shares)
                    grams = grams.filter(pa.array(of == share))
                    grams = grams.group_by("g").aggregate([("n", "sum")]).rename_columns(["g", "n"])
                some.append(grams)
            yield from pa.concat_tables(some).group_by("g").aggregate([("n", "sum")]).rename_columns(["g", "n"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            bucket, lo = batch.column(0).to_numpy(), 0
            # rows of one bucket follow one another
            for hi in [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(batch)] if len(batch) else []:
                if bucket[lo] != last and size >= limit // 4:
                    yield from counted(held)
                    held, size = [], 0
                piece = batch.slice(lo, hi - lo)
                held.append(piece)
                size, last, lo = size + piece.column(2).nbytes, bucket[lo], hi
        if held:
            yield from counted(held)

    return run


def _tasks(words: DataFrame) -> int:
    """Tasks for the count, by the bytes of the files read."""
    leaves = words._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in known if x < 1 << 60)  # more stands for a size that is not known
    return max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))


def counts(words: DataFrame, column: str, n: int) -> DataFrame:
    """g, n: the runs of `n` words of an array column, joined by blanks, and how often they stand. Words hold no white space.

    Equal n-grams are in one bucket and those of a bucket in one task; tasks are as many as the bytes behind `words` ask for.
    """
    spark = words.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    tasks = _tasks(words)
    packed = words.select(column).mapInArrow(_packed(n, SPREAD * tasks), "bucket int, n long, runs string")
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(n), "g string, n long")
