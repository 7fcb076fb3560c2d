"""Phrases counted by packed hashes, in slices of bounded size."""

import numpy as np
import pyarrow as pa
from prosemill.operators import phrases
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_work_is_cut_by_bytes_of_text():
    texts = ["x" * 10] * 7 + [None, "y" * 100, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 10), pa.array(texts)], names=["name", "text"])
    cut = list(phrases._sliced(iter([batch]), 30))
    assert pa.Table.from_batches(cut).column("text").to_pylist() == texts
    assert all(len(c) == 1 or sum(len(t or "") for t in c.column(1).to_pylist()) <= 30 for c in cut) and len(cut) == 5


def test_keys_that_stand_often_enough():
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0, 5], pa.int32()), pa.array([np.array(x, np.uint32).tobytes() for x in ([1, 2, 2**32 - 1], [2, 2**32 - 1, 2**32 - 1], [2])])], names=["bucket", "keys"])
    got = [k for b in phrases._reached(2)(iter([rows.slice(0, 1), rows.slice(1)])) for k in b.column(0).to_pylist()]
    assert got == [2, 2**32 - 1]
    assert [k for b in phrases._reached(1)(iter([rows.slice(2)])) for k in b.column(0).to_pylist()] == [(5 << 32) + 2]


def test_keys_count_by_different_names(spark):
    """A phrase that one name repeats over slices of the text passed the count and was spelled out and shuffled."""
    low, who = np.array([7, 7, 7, 9, 9], np.uint32), np.array([1, 1, 1, 1, 2], np.uint8)
    rows = pa.RecordBatch.from_arrays([pa.array([3, 3], pa.int32()), pa.array([low[:2].tobytes(), low[2:].tobytes()]), pa.array([who[:2].tobytes(), who[2:].tobytes()])], names=["bucket", "keys", "names"])
    assert [k for b in phrases._reached(2)(iter([rows])) for k in b.column(0).to_pylist()] == [(3 << 32) + 9]
    docs = [("a", "one phrase repeated here")] * 6 + [("b", "shared by some names"), (None, "shared by some names"), ("A", "shared by some names")]
    df = spark.createDataFrame(docs, "name string, text string").repartition(9)
    assert {(r.phrase, r.name) for r in phrases.frequent_names(df, "name", "text", (4,), 3).collect()} == {("shared by some names", x) for x in ("a", "b", None)}
    most, phrases.MOST_NAMES = phrases.MOST_NAMES, 2
    try:
        assert {r.phrase for r in phrases.frequent(phrases.frequent_names(df, "name", "text", (4,), 3), 3).collect()} == {"shared by some names"}
    finally:
        phrases.MOST_NAMES = most


def test_a_task_spells_a_phrase_once_a_name():
    """Each slice of 4 MB spelled out all of its phrases anew."""

    class All:
        def has(self, h):
            return np.ones(len(h), bool)

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", None, "None"]), pa.array(["x y z"] * 4)], names=["name", "text"])
    got = [tuple(r.values()) for b in phrases._spelled(All(), (2, 3))(iter([batch] * 5)) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted(((n, p, x) for x in ("a", "b", None, "None") for n, p in ((2, "x y"), (2, "y z"), (3, "x y z"))), key=str)


def test_removal_holds_a_few_texts_at_a_time(spark):
    """10,000 texts were held by a worker at once, however long they were."""

    @F.arrow_udf(T.LongType())
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3000, numPartitions=1).select(F.concat(F.lit("a used for the treatment of "), F.repeat(F.lit("wxyz "), 1000)).alias("t"))
    removed = phrases.remove_phrases(F.col("t"), ("used for",))
    row = docs.select(held("t").alias("bytes"), removed.alias("t")).agg(F.max("bytes").alias("bytes"), F.min("t").alias("t")).first()
    assert row.bytes <= phrases.SLICE + 20_000 and row.t.startswith("a the treatment of wxyz")


def test_phrases_of_rare_parts_are_not_counted(spark, monkeypatch):
    """All runs of each size were shuffled to be counted, also those whose parts are too rare."""
    listed = []
    monkeypatch.setattr(phrases, "_reached", lambda least, kept=phrases._reached: (listed.append(least), kept(least))[1])
    texts = pa.array(["a b c d e", "x b c d y"])
    every = {k: h for k, h, *_ in phrases._runs(texts, (3, 4))}

    class Shared:
        def has(self, h):
            return np.isin(h, every[3][[0, 1]] & phrases._KEY)  # a b c, b c d

    h, row = phrases._hopeful(texts, 4, (3, Shared()))
    assert h.tolist() == [every[4][0]] and row.tolist() == [0]
    rows = [(f"s{i}", f"p{i} one two three four q{i}") for i in range(6)] + [("s0", "one two three five")]
    df = spark.createDataFrame(rows, "name string, text string")
    got = phrases.frequent(phrases.frequent_names(df, "name", "text", (3, 4, 5), 5), 5).collect()
    assert {(r.n, r.phrase, r.total) for r in got} == {(3, "one two three", 6), (3, "two three four", 6), (4, "one two three four", 6)}
    assert listed == [5, 5, 5]


def test_phrases_are_not_shuffled_to_tell_names_apart(spark):
    """Each join of names carried the texts of the phrases."""
    rows = [(3, "one two three", x) for x in ("alpha", "alpha two", "beta", "gamma", None)] + [(4, "one two three four", x) for x in ("alpha", "alphabet", "beta")]
    got = phrases.dissimilar(spark.createDataFrame(rows, "n int, phrase string, name string").repartition(3), 3)
    assert {tuple(r) for r in got.collect()} == {(3, "one two three", 5, 4)}
    dealt = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1:] if "phrase" in x.split("\n")[0]]
    assert not dealt
