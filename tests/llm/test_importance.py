"""Importance resampling against plain counts."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pytest
from prosemill.llm import importance as I
from pyspark.sql import functions as F


SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _weights(rows, target, grams):
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    at = lambda g: zlib.crc32(g.encode()) % I.BUCKETS
    s, t = Counter(at(g) for _, x in rows for g in runs(_words(x))), Counter(at(g) for x in target for g in runs(_words(x)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + I.BUCKETS) / ((s[b] + 1) * (n_t + I.BUCKETS)))) for b in s}
    return [(i, len(_words(x)), len(runs(_words(x))), sum(gain[at(g)] for g in runs(_words(x)))) for i, x in rows]


@pytest.mark.parametrize("grams", [1, 2, 4])
@pytest.mark.parametrize("block", [I.BLOCK, 3000])
def test_weights(spark, edge, edge_rows, monkeypatch, grams, block):
    monkeypatch.setattr(I, "BLOCK", block)
    target = ["w1 w2 w3 W4", "ÄÖ ß one", None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = I.weigh(spark, edge, frame, grams=grams).collect()
    assert Counter(map(tuple, got)) == Counter(_weights([(i, t) for i, t, _ in edge_rows], target, grams))


def test_empty_tables(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert I.draw(spark, I.weigh(spark, empty, none)).count() == 0
    got = I.weigh(spark, edge, none)
    assert got.count() == edge.count() and got.filter("n_words = 0 and weight <> 0").count() == 0


def test_draw(spark):
    """A tenth of the rows with enough words, by score; ties by identifier; repeated rows and null identifiers too."""
    rows = [(i, 20 + i % 3, i, 100) for i in range(95)] + [(7, 20, 7, 100)] * 3 + [(None, 30, 1, 100), (200, 19, 1, 10**9)]
    frame = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long")
    got = I.draw(spark, frame).collect()
    noise = lambda i: math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32)))
    assert all(r.score == r.weight + noise(r.id) for r in got) and len(got) == len(rows)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 10))  # a tenth of 99
    fit = sorted((-(w + noise(i)), -1 if i is None else i) for i, n, _, w in rows if n >= 20)
    assert [(-r.score, -1 if r.id is None else r.id) for r in drawn] == fit[:9]
    tied = spark.range(100).select(F.lit(5).cast("long").alias("id"), F.lit(50).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"))
    assert sorted(r["rank"] for r in I.draw(spark, tied).filter("rank is not null").collect()) == list(range(1, 11))


def test_query_equals_sql(spark):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    assert sorted(map(tuple, I.op12_importance(spark, SF).collect())) == sorted(db.sql(I.ORACLE).fetchall())
