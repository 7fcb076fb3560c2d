"""Sources, sinks and runs over files, and phrase detection against brute force."""

import os
import random
import re
from collections import defaultdict

import duckdb
import pytest
from prosemill.functions import text as X
from prosemill.operators import phrases
from prosemill.plans import files, queries, tables  # noqa: F401
from prosemill.sources import readers, writers
from pyspark.sql import functions as F

from .test_core import SF, _rows


@pytest.mark.parametrize(
    "name",
    ["read_products", "scraped_file", "enriched_file", "boiled_missing_values", "cohort_file", "truth_file", "report_files", "store_metadata_one_kind", "xml_scan", "run_files", "embedding_run", "evaluation_per_item", "evaluation_files", "existence_guards", "compare_files", "match_tables", "encode_store", "sample_seeded", "phrase_dissimilar", "cosine_marks", "cosine_range"],
)
def test_oracle(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(db.sql(queries.ORACLES[name]).df())


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    """Small files before large ones and splits within files: Spark deals them out by size, the numbers do not follow it."""
    want = []
    for i, n in enumerate((5, 4000, 1, 900)):
        rows = [f"f{i}r{j}" for j in range(n)]
        want += rows
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f"{r},x\n" for r in rows))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = readers.csv(spark, str(tmp_path), ["a"]).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.a for r in got] == want and [r.row_id for r in got] == list(range(len(want)))


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"one\ntwo",x\n"say ""hi"", then",\n')
    got = readers.csv(spark, str(tmp_path / "a.csv"))
    assert [(r.a, r.b) for r in got.orderBy("row_id").collect()] == [("one\ntwo", "x"), ('say "hi", then', "")]
    assert got.count() == 2  # also where no column is asked for


def test_written_cells_come_back(spark, tmp_path):
    rows = [(0, ' lead, "quote"', "tail ", "a;b"), (1, "", "é\\n", "'"), (2, '"', ",", "")]
    df = spark.createDataFrame(rows, "row_id long, generic_name string, drug_name string, description string")
    writers.stage(df, str(tmp_path / "o"), "row_id")
    back = readers.csv(spark, str(tmp_path / "o"), ["Generic Name", "Drug Name", "Description"]).orderBy("row_id").collect()
    assert [tuple(r) for r in back] == [(*r[1:], r[0]) for r in rows]


def test_store_with_unlike_lengths_fails(spark, tmp_path):
    rows = spark.createDataFrame([("atc", "a", [1.0]), ("atc", "b", [1.0, 2.0])], "embedding_type string, drug_name string, embedding array<float>")
    with pytest.raises(Exception, match="unlike lengths"):
        writers.embedding_store(rows, str(tmp_path / "s"), "m")
    writers.embedding_store(rows.limit(0), str(tmp_path / "e"), "m")
    assert [tuple(r)[:2] for r in readers.store_metadata(spark, str(tmp_path / "e")).collect()] == [(0, 0)]


def test_phrases_by_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "Gamma", "δelta", "of", "the"]
    names = ["src", "src one", "src1", "Src2", "other", "another", "src1x", None, "é long", "x é long"]
    gaps = [" ", "  ", "\t", " ", "　 ", "\n"]
    rows = [(rng.choice(names), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 25)))) for _ in range(150)] + [("a", None), ("b", "")]
    df = spark.createDataFrame(rows, "name string, text string")
    held = defaultdict(set)
    for name, text in rows:
        w = [x for x in re.split(r"[\s 　]+", text or "") if x]
        for n in (3, 4):
            for j in range(len(w) - n + 1):
                phrase = " ".join(w[j : j + n])
                if len(phrase.encode()) >= 10:
                    held[n, phrase].add(name and name.lower())

    def similar(a, b):
        fa, fb = (a.split() or [""])[0], (b.split() or [""])[0]
        return (fa == fb and fa != "") or (len(fa.encode()) >= 4 and len(fb.encode()) >= 4 and (a in b or b in a))

    want, totals = {}, {}
    for k, who in held.items():
        if len(who) >= 3:
            totals[k] = len(who)
            some = sorted(x for x in who if x is not None)
            distinct = sum(not any(similar(e, x) for e in some[:i]) for i, x in enumerate(some)) + (None in who)
            if distinct >= 3:
                want[k] = (len(who), distinct)
    found = phrases.frequent_names(df, "name", "text", (3, 4), 3)
    assert {(r.n, r.phrase): r.total for r in phrases.frequent(found, 3).collect()} == totals and totals
    assert {(r.n, r.phrase): (r.total, r.distinct_names) for r in phrases.dissimilar(found, 3).collect()} == want and want
    assert phrases.dissimilar(phrases.frequent_names(df.limit(0), "name", "text", (3,), 3), 3).count() == 0


def test_first_row_wins_over_splits(spark):
    from prosemill.plans import pipeline

    raw = spark.createDataFrame([(2, "B", "x", "later"), (1, "b ", "X", "first"), (3, "c", "x", "")], "row_id long, `Generic Name` string, `Brand Name` string, `Pharmacologic Category` string")
    assert {(r.generic_name, r.category) for r in pipeline.scrape(raw).collect()} == {("b", "first"), ("c", "")}
    assert pipeline.named(spark.createDataFrame([("", "none")], "generic_name string, drug_name string"), strict=False).count() == 0
    with pytest.raises(Exception, match="without a name"):
        pipeline.named(spark.createDataFrame([("", "none")], "generic_name string, drug_name string"), strict=True).collect()
    assert spark.range(1).select(X.display_label(F.lit("asthma_x"))).first()[0] == "ASTHMA"
