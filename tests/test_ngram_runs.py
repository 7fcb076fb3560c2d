"""N-grams counted over runs of words against plain counts."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from prosemill.operators import ngram_runs
from prosemill.plans import queries
from pyspark.sql import functions as F

from .test_core import SF

_RANDOM = random.Random(5)
TEXTS = [None, [], ["a"], ["a", "b", "c"], ["x", "y"] * 300, ["z"] * 500, *[[_RANDOM.choice(["a", "b", "of", "the", "é", "\U0001f600"]) for _ in range(_RANDOM.randrange(40))] for _ in range(80)], ["same", "line", "of", "five", "words"]]


def _plain(n):
    return Counter(" ".join(t[i : i + n]) for t in TEXTS if t for i in range(len(t) - n + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
@pytest.mark.parametrize("step", [1 << 20, 5])
def test_each_ngram_stands_in_one_run(monkeypatch, n, step):
    monkeypatch.setattr(ngram_runs, "STEP", step)
    got, keys = Counter(), {}
    for key, said, times in ngram_runs._runs(pa.array(TEXTS, pa.list_(pa.string())), n):
        for k, run, many in zip(key.tolist(), said.to_pylist(), times.tolist(), strict=True):
            w = run.split(" ")
            assert n <= len(w) < n + ngram_runs.LONGEST
            for g in (" ".join(w[i : i + n]) for i in range(len(w) - n + 1)):
                got[g] += many
                assert keys.setdefault(g, k) == k
    assert got == _plain(n)


def test_buckets_of_many_bytes_are_counted_by_shares():
    packed = list(ngram_runs._packed(4, 3)(iter([pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], names=["words"]) for t in (TEXTS, TEXTS[:6], [None], [["a"], ["b", "c"]])])))
    rows = pa.Table.from_batches(packed).sort_by("bucket").to_batches(max_chunksize=2)
    for limit in (1 << 20, 64):
        got = [(g, n) for b in ngram_runs._count(4, limit)(iter(rows)) for g, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(got) == len(dict(got)) and Counter(dict(got)) == _plain(4) + Counter(" ".join(t[i : i + 4]) for t in TEXTS[:6] if t for i in range(len(t) - 3))


def test_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "words array<string>").repartition(5)
    assert {r.g: r.n for r in ngram_runs.counts(df, "words", 4).collect()} == _plain(4)
    assert ngram_runs.counts(df.limit(0), "words", 4).collect() == []


def test_no_ngram_is_shuffled(spark):
    """Each n-gram was shuffled with all its words."""
    plan = queries.QUERIES["sql_ngrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partitioning(g" not in plan and plan.count("Exchange") == 1


def test_tasks_go_by_the_bytes_read(spark, monkeypatch):
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.split("text", " ").alias("words"))
    monkeypatch.setattr(ngram_runs, "TASK", 1 << 14)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ngram_runs._tasks(words) > 2 * least
    assert ngram_runs._tasks(spark.createDataFrame(words.rdd)) == least  # no size is known
