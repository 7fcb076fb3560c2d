"""Golden vectors, oracle comparison of the quick queries, and properties of the core engine."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.operators import phrases
from prosemill.plans import queries

SF = "/root/testdata/sf0.001"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("Acetaminophen (oral)", "acetaminophen"), ("Amoxicillin/Clavulanate", "amoxicillin / clavulanate"), ("a (b (c) d)", "a d"), ("Montélukast® [obsolete]", "montelukast"), ("Ācid", "cid")],
)
def test_clean_generic(spark, given, want):
    assert one(spark, given, lambda c: F.lower(X.clean_generic(c))) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Used for the treatment of hypertension in adult patients with diabetes.", "Used for hypertension in diabetes"),
        ("Used for the treatment of mild to moderate pain in adult patients with arthritis.", "Used for pain in arthritis"),
        ("Treats infections caused by susceptible bacteria in patients with pneumonia.", "Treats infections bacteria pneumonia"),
        ("Treatment of advanced or metastatic breast cancer in combination with chemotherapy.", "Treatment of chemotherapy"),
        ("the the treatment of treatment of asthma", "asthma"),
        ("the treatment of", ""),
    ],
)
def test_remove_phrases(spark, given, want):
    assert one(spark, given, phrases.remove_phrases) == want


def test_key_information(spark):
    text = "Amoxicillin is an antibiotic [A123] that inhibits bacterial cell wall synthesis in susceptible organisms. It is used to treat respiratory tract infections; indicated for otitis media in children."
    assert one(spark, text, X.key_information) == "antibiotic. bacterial cell wall synthesis in susceptible organisms. otitis media in children; respiratory tract infections"


def test_fold_is_idempotent(spark):
    text = "Naproxén—NSAID “quoted” … ≥5  Łódź Ÿ"
    once = one(spark, text, X.fold_ascii)
    assert one(spark, once, X.fold_ascii) == once and once.isascii()


def test_too_few_words_make_no_ngrams(spark):
    assert one(spark, "a b", lambda c: X.ngrams(c, 3)) == []
    assert one(spark, "a b c d", lambda c: X.ngrams(c, 3)) == ["a b c", "b c d"]


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["scrape", "match_substring", "match_cascade", "enriched_description", "extract_key_info", "unboil", "dedup_first", "dedup_keyed", "phrase_overlap_dedup", "cosine_levels", "tfidf_stats", "sql_script"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(db.sql(queries.ORACLES[name]).df())


def test_same_on_streams(spark, tmp_path):
    from prosemill.streaming.cleaning import clean_stream

    rows = spark.createDataFrame([("Pain in patients with diabetes",)], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "text")
    q = stream.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT text FROM cleaned").first()[0] == "Pain diabetes"


def test_run_end_to_end(spark, tmp_path):
    from prosemill.plans import pipeline

    (tmp_path / "p.csv").write_text("Generic Name,Brand Name,Pharmacologic Category,Other\nAmoxicillin (oral),Amox,Antibiotic,1\nAMOXICILLIN,amox,-,2\n")
    (tmp_path / "k.xml").write_text("<d><drug><name>Amoxicillin</name><description>It is indicated for ear infections in adult patients with pain.</description><atc-codes><atc-code code='J01'>x</atc-code></atc-codes></drug></d>")
    out = pipeline.run(spark, pipeline.Config(str(tmp_path / "p.csv"), str(tmp_path / "k.xml"), str(tmp_path / "o"), str(tmp_path / "u"))).collect()
    assert [(r.generic_name, r.description, r.atc_codes) for r in out] == [("amoxicillin", "antibiotic; ear infections in pain", "J01")]
