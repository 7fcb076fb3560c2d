"""Queries over the tables against DuckDB, and what they rest on: removal, publishing, counters, streams, buckets, cohorts."""

import os
import random
import re
import subprocess
import sys
import time

import duckdb
import pytest
from prosemill.functions import constants as C
from prosemill.functions import sql as S
from prosemill.functions import text as X
from prosemill.operators import dedup, match, phrases, sampling, tfidf, tfidf_model
from prosemill.plans import pipeline, queries, tables
from prosemill.sources import metrics, publish, readers, writers
from prosemill.streaming import dedup as stream_dedup
from pyspark.sql import functions as F

from .test_core import SF, _rows

NAMES = [
    "csv_line_breaks", "stage_line_breaks", "xml_elements", "xml_strict", "published_version", "unboil_all", "counted_write", "stream_first", "stream_last", "sql_functions", "sql_ngrams", "sql_table_ngrams",
    "tfidf_model", "bucket_lookup", "cohort_evaluation", "document_category", "document_mechanism", "document_indications", "document_told_fallback", "document_information", "document_predicates",
    "enrich_documents", "run_documents", "run_counters", "document_names", "document_named_rows", "document_display_lookup", "scrape_documents", "match_brand_tables", "match_substring_tables",
    "cohort_samples", "evaluation_stats", "evaluation_missing",
]


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for file in os.listdir(SF):
        held.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    return held


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, db, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(db.sql(queries.ORACLES[name]).df())


# removal
def _plainly(text, listed):
    for phrase in listed:
        while (at := phrases.lowered(text).find(phrase)) >= 0:
            left, right = text[:at].rstrip(phrases.TRIM), text[at + len(phrase) :].lstrip(phrases.TRIM)
            text = f"{left} {right}" if left and right else left or right
    return re.sub(r"\s+", " ", text).strip(phrases.TRIM)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("İ" * 50 + " the treatment of", "İ" * 50), ("İİİİ abc the treatment of pain", "İİİİ abc pain"), ("the İ the treatment of İ, in patients with İ", "the İ İ İ"),
        ("in combin the treatment of ation with x", "in combin ation with x"), ("the the treatment of treatment of asthma", "asthma"), ("in patients WHO", ""), (None, None), ("", ""),
    ],
)
def test_letters_that_change_length(spark, tmp_path, text, want):
    frame = spark.createDataFrame([(text,)], "text string")
    assert frame.select(phrases.remove_phrases(F.col("text"))).first()[0] == want


def test_removal_by_brute_force():
    rng = random.Random(1)
    words = sorted({w for p in C.PHRASES for w in p.split()}) + ["İ", "pain", ",", ".", "ÀB", "K"]
    for _ in range(4000):
        parts = []
        for _ in range(rng.randint(1, 12)):
            p, q = rng.choice(C.PHRASES), rng.choice(C.PHRASES)
            k = rng.randint(1, len(p) - 1)
            parts.append(rng.choice([p, p[:k] + rng.choice(["", " ", q, " " + q, f", {q} "]) + p[k:], rng.choice(words)]))
        text = rng.choice([" ", "", ", "]).join(parts)
        text = text.title() if rng.random() < 0.3 else text
        assert phrases.remove_once(text, C.PHRASES) == _plainly(text, C.PHRASES)
    assert phrases.remove_once("a b", []) == "a b" and phrases.remove_once("a b a", ["a", "a"]) == "b"


# publishing
def test_a_failed_run_leaves_what_was_published(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(0, "a", "b", "x\ny", "")], "row_id long, generic_name string, drug_name string, description string, atc_codes string")
    writers.stage(rows, path, "row_id")
    broken = rows.withColumn("description", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        writers.stage(broken, path, "row_id")
    assert [r.Description for r in readers.enriched(spark, path).collect()] == ["x\ny"]
    before = publish.current(spark, path)
    writers.stage(rows.withColumn("drug_name", F.lit("c")), path, "row_id")
    assert [r["Drug Name"] for r in readers.enriched(spark, path).collect()] == ["c"]
    assert os.path.isdir(before.removeprefix("file:"))  # for those that still read it
    for _ in range(3):
        writers.stage(rows, path, "row_id")
    assert sum(d.startswith("v-") for d in os.listdir(path)) == 2


# extraction
def test_texts_are_parsed_and_searched_once(spark, tmp_path):
    """An element is parsed by one expression, filters included, and an entity's text is searched below the join, once a pattern's use."""
    (tmp_path / "base.xml").write_text("<drug><name>A b</name><description>It works by blocking receptors of pain in all.</description></drug>")
    base = readers.knowledge_base(spark, str(tmp_path / "base.xml"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(base).count("from_xml") == 1
    products = spark.createDataFrame([(0, "a b", "none", "Cat", "a b"), (1, "a b", "x", "", "a b"), (2, "c", "x", "-", None)], "row_id long, generic_name string, drug_name string, category string, name_key string")
    enriched = match.enrich(products, base)
    assert plan(enriched).count("exerts its effects") <= 3
    assert {r.row_id: (r.description, r.matched, r.cleaned) for r in enriched.collect()} == {0: ("cat; blocking receptors of pain in all", True, True), 1: ("blocking receptors of pain in all", True, True), 2: ("-", False, False)}


def test_substrings_read_the_dictionary_once(spark, tmp_path):
    spark.createDataFrame([("alpha",), ("alphabet soup",), ("bet soup ab",), ("soup",), ("alp",)], "name_key string").write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    products = spark.createDataFrame([(0, "Alphabet / bet soup", "x"), (1, "alphabet soup / alp", "x"), (2, "soup", "x")], "row_id long, generic_name string, drug_name string")
    got = match.component_substring(products, known)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [name_key") == 1
    want = {(0, 0, "alpha"), (0, 0, "alphabet soup"), (0, 1, "soup"), (0, 1, "bet soup ab"), (0, 1, "alphabet soup"), (1, 0, "alpha"), (1, 0, "alphabet soup"), (1, 0, "soup")}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_records_of_lines_stay_where_they_are(spark, tmp_path):
    """Sums of byte ranges and header counts are broadcast: only lines of several are shuffled, once, by no join."""
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n2,c\n')
    rows = readers.csv(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sizes are unknown
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(map(tuple, rows.collect())) == [("1", "a\nb", 0), ("2", "c", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# counters
def test_counters_come_from_the_write(spark, tmp_path):
    spark.range(100).withColumn("v", F.concat(F.lit("the treatment of "), F.col("id"))).write.parquet(str(tmp_path / "in"))
    counters = metrics.Counters()
    rows = spark.read.parquet(str(tmp_path / "in")).withColumn("after", phrases.remove_phrases(F.col("v")))
    seen = counters.watch(rows, "removal", **metrics.removal("v", "after"))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    seen.write.parquet(str(tmp_path / "out"))
    assert counters["removal"] == {"processed": 100, "changed": 100, "emptied": 0}
    assert counters.row()["removal_changed"] == 100


# streams
def test_late_rows_within_the_watermark(spark, tmp_path):
    """A row of a later batch that comes first by its order replaces what was given out."""
    schema = "k string, n long, ts timestamp, v string"
    for i, rows in enumerate(([("a", 5, "2024-01-01 10:00", "x"), ("b", 1, "2024-01-01 10:00", "y"), ("a", 7, "2024-01-01 10:05", "z")], [("a", 2, "2024-01-01 09:30", "late"), ("c", 9, "2024-01-01 10:10", "w"), ("b", 1, "2024-01-01 10:00", "again")])):
        spark.createDataFrame(rows, "k string, n long, ts string, v string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 2
    spark.conf.set(*stream_dedup.STORE)
    try:
        events = spark.read.parquet(str(tmp_path / "in"))
        for name, way, plain in (("f", stream_dedup.first_in_stream, dedup.first_wins), ("l", stream_dedup.last_in_stream, dedup.last_wins)):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            stream_dedup.drain(way(stream, ["k"], "n", "ts", "1 day"), str(tmp_path / f"o{name}"), str(tmp_path / f"c{name}"))
            got = stream_dedup.latest(spark.read.parquet(str(tmp_path / f"o{name}")), ["k"])
            assert {(r.k, r.n) for r in got.collect()} == {(r.k, r.n) for r in plain(events, ["k"], "n").collect()}
    finally:
        spark.conf.unset(stream_dedup.STORE[0])


def test_a_key_that_comes_back_after_its_state_is_dropped(spark, tmp_path):
    """The first of all rows stays the result; rows of a key in several spans of one batch are one result; nulls order last."""
    schema = "k string, n long, ts timestamp, v string"
    batches = [("a", 1, "2024-01-01 10:00", "x"), ("c", 4, "2024-01-01 10:00", "s")], [("b", 1, "2024-01-20 10:00", "y"), ("b", 2, "2024-03-20 10:00", "z")], [("a", 5, "2024-03-20 10:00", "late"), ("c", None, "2024-03-20 10:00", "t")]
    for rows in batches:
        spark.createDataFrame(rows, "k string, n long, ts string, v string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    for name, way, want in (("f", stream_dedup.first_in_stream, {"a": 1, "b": 1, "c": 4}), ("l", stream_dedup.last_in_stream, {"a": 5, "b": 2, "c": 4})):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_dedup.drain(way(stream, ["k"], "n", "ts"), str(tmp_path / f"o{name}"), str(tmp_path / f"c{name}"))
        got = stream_dedup.latest(spark.read.parquet(str(tmp_path / f"o{name}")), ["k"]).collect()
        assert {r.k: r.n for r in got} == want


def test_events_without_a_time_count(spark, tmp_path):
    rows = [(1, None, 7, "view", 1.0, ""), (2, "2024-01-05 00:00:00", 7, "view", 2.0, ""), (3, None, 7, "view", 3.0, ""), (4, None, 8, "view", 4.0, "")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    for name, want in (("stream_first", {1, 4}), ("stream_last", {3, 4})):
        assert {r.event_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} == want


# SQL functions
def test_sql_functions_are_the_rules(spark):
    made = S.register(spark, "t_")
    rows = queries.TEXTS.df(spark)
    rows.createOrReplaceTempView("t_rows")
    for name, (rule, _) in S.ONE.items():
        assert rows.select("id", rule(F.col("text"))).collect() == [tuple(r) for r in spark.sql(f"SELECT id, t_{name}(text) FROM t_rows").collect()], name
    assert [r[0] for r in rows.select(X.fallback_sentence(F.col("text"))).collect()] == [r[0] for r in spark.sql("SELECT t_entity_sentence(text) FROM t_rows").collect()]
    names = spark.createDataFrame([("Acme one", "acme two"), ("zinc", "zinc oxide"), ("abc", "abcd"), ("", ""), ("x alpha", "alpha")], "a string, b string")
    names.createOrReplaceTempView("t_names")
    assert [r[0] for r in names.select(X.similar_names(F.col("a"), F.col("b"))).collect()] == [r[0] for r in spark.sql("SELECT t_similar_names(a, b) FROM t_names").collect()]
    array = spark.sql("SELECT id, pos, g FROM (SELECT id, t_text_ngrams(text, 3) AS gs FROM t_rows) LATERAL VIEW posexplode(gs) AS pos, g").collect()
    listed = spark.sql("SELECT id, pos, ngram FROM t_rows, LATERAL t_ngrams(text, 3)").collect()
    assert sorted(map(tuple, array)) == sorted(map(tuple, listed)) == sorted(map(tuple, rows.select("id", F.posexplode(X.ngrams(F.col("text"), 3))).collect()))
    assert spark.sql("SELECT t_text_ngrams(CAST(NULL AS STRING), 2), t_text_ngrams('a b', 0), t_text_ngrams('a', 2)").first()[1:] == ([], [])
    assert "t_unique_key" in made


# fitted model
def test_saved_model_transforms_like_the_fitted_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b b c"), (2, "a d"), (3, None), (4, "")], "item long, text string")
    model = tfidf_model.TfidfEstimator().fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = tfidf_model.TfidfModel.load(str(tmp_path / "m"))
    key = lambda d: sorted((r.item, r.term, round(r.weight, 12)) for r in d.collect())
    assert key(loaded.transform(rows)) == key(model.transform(rows)) == key(tfidf.weights(rows, "item", "text", tfidf.vocabulary(rows, "text")))
    assert key(loaded.transform(spark.createDataFrame([(9, "zz b")], "item long, text string"))) == [(9, "b", 1.0)]


# buckets
STORE_NAME = "store_of_test_" + os.urandom(4).hex()


def test_lookup_by_bucket_does_not_shuffle_the_store(spark):
    spark.sql("DROP TABLE IF EXISTS " + STORE_NAME)
    rows = spark.range(200).select(F.lit("description").alias("embedding_type"), F.concat(F.lit("g"), "id").alias("drug_name"), F.array(F.lit(1.0)).alias("embedding"))
    writers.bucketed_store(rows, STORE_NAME, 8)
    out = readers.bucketed_vectors(spark, STORE_NAME, spark.range(50, 300).select(F.concat(F.lit("g"), "id").alias("drug_name")))
    assert out.count() == 150
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = plan.index(STORE_NAME)
    above = plan[:scan].splitlines()
    indent = len(above[-1]) - len(above[-1].lstrip(" :+-*"))
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") <= 1 and indent > 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets
    try:
        few = spark.table(STORE_NAME).filter("drug_name = 'g7'")
        assert "SelectedBucketsCount: 1 out of 8" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.sql("DROP TABLE " + STORE_NAME)


# cohorts
def test_cohorts_in_one_plan_are_the_single_ones(spark):
    rng = random.Random(2)
    rows = [(i, f"g{i % 7}" if i != 30 else " ", rng.choice(["none", f"b{i}"]) if i != 30 else "", f"text of {'asthma' if i % 3 else 'nsaid'} {i % 11} {i % 5}") for i in range(60)]
    boiled = spark.createDataFrame(rows, "row_id long, generic_name string, drug_name string, description string")
    specs = (("asthma_x", "description", "asthma", 20), ("nsaid", "description", "nsaid", 9), ("few", "generic_name", "g3", 100), ("none", "description", "zz", 5), ("all_of", "description", "text", 60))
    together = pipeline.cohort_rows(boiled, specs)
    for name, alone in pipeline.cohorts(boiled, specs).items():
        assert {r.row_id for r in alone.collect()} == {r.row_id for r in together.filter(F.col("dataset") == name.split("_")[0]).collect()}
    store = boiled.select(X.unique_key(F.col("generic_name"), X.brand_or_generic(F.col("generic_name"), F.col("drug_name"))).alias("drug_name"), F.array(F.col("row_id") + 1.0, F.lit(3.0)).alias("embedding"))
    got = {r.dataset: r for r in pipeline.evaluate_cohorts(boiled, store, specs).collect()}
    assert {k: (r.n_rows, r.error) for k, r in got.items()} == {"asthma": (20, ""), "nsaid": (9, got["nsaid"].error), "few": (8, ""), "none": (0, "no rows"), "all": (60, "row without a name")}
    one = pipeline.evaluate(pipeline.cohorts(boiled, specs)["asthma_x"], store, "asthma")["per_item"].agg(F.avg("avg_similarity")).first()[0]
    two = pipeline.evaluate_tfidf(pipeline.cohorts(boiled, specs)["asthma_x"], boiled, "asthma")["per_item"].agg(F.avg("avg_similarity")).first()[0]
    assert abs(got["asthma"].mean_a - one) < 1e-9 and abs(got["asthma"].mean_b - two) < 1e-9
    assert got["all"].mean_b is None and got["all"].mean_a is not None


def test_samples_of_groups_are_the_samples(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "big").otherwise("small").alias("g"), "id", F.when(F.col("id") < 400, 30).otherwise(1000).alias("n"))
    got = sampling.sample_each(rows, "g", "n", ["id"])
    want = {r.id for r in sampling.sample(rows.filter("g = 'big'"), 30, "id").collect()}
    assert {r.id for r in got.filter("g = 'big'").collect()} == want and got.filter("g = 'small'").count() == 100


# packaging
def test_a_session_started_elsewhere(tmp_path):
    """Workers find the package although the session was started in another folder, without PYTHONPATH."""
    entry = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {entry!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as E
print("rows", E.queries()["unboil"](spark, {SF!r}).count())
print("rows", len(E.queries()["flagship_phrases"](spark, {SF!r}).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("rows") == 2, done.stderr[-2000:]
    assert tables.register is queries.register


# filters
def test_phrases_with_filters_that_would_be_full(spark, monkeypatch):
    """Many more keys than a filter has bits: the keys are shared out, results are equal, and few single phrases are spelled out."""
    from prosemill.operators.keyfilter import KeyFilter

    rng = random.Random(6)
    words = [f"word{i}" for i in range(200)]
    rows = [(f"name{i % 9}", " ".join(rng.choice(words) for _ in range(300)) + " a shared run of words here") for i in range(40)]
    frame = spark.createDataFrame(rows, "name string, text string")
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(phrases.frequent_names(frame, "name", "text", (2, 3, 5), 3))
    every = phrases.phrase_names(frame, "name", "text", (2, 3, 5)).count()
    monkeypatch.setattr(KeyFilter, "LEAST_BITS", 1 << 10)
    monkeypatch.setattr(KeyFilter, "MOST_BITS", 1 << 10)
    got = phrases.frequent_names(frame, "name", "text", (2, 3, 5), 3)
    frequent = lambda r: sorted(map(tuple, r.groupBy("n", "phrase").agg(F.count(F.lit(1)).alias("c")).filter("c >= 3").collect()))
    assert frequent(got) == frequent(spark.createDataFrame(want, "n int, phrase string, name string")) != []
    often = {x[:2] for x in frequent(got)}
    single = sum((r.n, r.phrase) not in often for r in got.collect())
    assert single < 0.4 * every
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    filters = KeyFilter.shared(spark, stored_keys := keys)
    assert len(filters) == 12 and stored_keys.count() == 3000
    import numpy as np

    asked = np.array([r.key for r in keys.collect()], np.int64)
    assert (sum(f.has(asked).astype(int) for f in filters) == 1).all()  # each key is in one filter
