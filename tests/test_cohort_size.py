"""What samples of cohorts move: draws of all rows, texts of the sample only."""

import random

from prosemill.operators import sampling, tfidf
from pyspark.sql import functions as F


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_outside_the_sample_are_not_shuffled(spark, tmp_path):
    made = random.Random(4)
    spark.createDataFrame([(i, made.choice("abc"), made.randbytes(1000).hex()) for i in range(2000)], "id long, g string, t string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).withColumn("n", F.lit(5))
    before = _shuffled(spark)
    got = sampling.sample_each(rows, "g", "n", ["t", "id"]).collect()
    moved = sum(n for stage, n in _shuffled(spark).items() if stage not in before)
    want = {(g, r.id) for g in "abc" for r in sampling.sample(rows.filter(F.col("g") == g), 5, ["t", "id"]).collect()}
    assert {(r.g, r.id) for r in got} == want and len(got) == 15
    assert 0 < moved < 500_000, moved  # all texts are 4 MB, or 2 MB packed


def test_odd_groups_and_equal_draws(spark):
    rows = [(None, 2, "x", i) for i in range(6)] + [("a", None, "x", 1), ("b", 0, "x", 1), ("c", 9, "x", 1), ("d", 2, "x|1", 1), ("d", 2, "x|1", 1), ("d", 2, "x|1", 1)]
    df = spark.createDataFrame(rows, "g string, n int, t string, id long")
    got = sorted((r.g or "", r.t, r.id) for r in sampling.sample_each(df, "g", "n", ["t", "id"]).collect())
    some = {r.id for r in sampling.sample(df.filter("g is null"), 2, ["t", "id"]).collect()}
    assert got == sorted([("", "x", i) for i in some] + [("c", "x", 1), ("d", "x|1", 1), ("d", "x|1", 1)])
    clash = spark.createDataFrame([("g", 1, "u|v", "w"), ("g", 1, "u", "v|w")], "g string, n int, a string, b string")  # one draw, other keys
    assert [(r.a, r.b) for r in sampling.sample_each(clash, "g", "n", ["a", "b"]).collect()] == [("u", "v|w")]


def test_a_vocabulary_of_some_terms(spark):
    docs = spark.createDataFrame([("one two two",), ("two three",), (None,), ("One, four",)], "t string")
    among = tfidf.terms(spark.createDataFrame([("two one",), ("One five!",), (None,)], "t string"), "t")
    assert sorted(r.term for r in among.collect()) == ["five", "one", "two"]
    whole = {tuple(r) for r in tfidf.vocabulary(docs, "t").collect()}
    assert {tuple(r) for r in tfidf.vocabulary(docs, "t", among).collect()} == {r for r in whole if r[0] in ("one", "two")}
