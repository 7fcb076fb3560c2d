"""Core jobs that were done in part before."""

import os

import duckdb
import pytest
from prosemill.plans import pipeline, queries

from .test_core import SF, _rows


@pytest.mark.parametrize("name", ["cosine_item_levels", "cosine_item_level_means"])
def test_oracle_of_whole_bands(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(db.sql(queries.ORACLES[name]).df())


def test_evaluate_reports_bands_of_the_cohort_size(spark):
    rows = [(f"drug{i}", f"brand{i}", f"text {i % 3} of {i % 5} kinds") for i in range(12)]
    cohort = spark.createDataFrame(rows, "generic_name string, drug_name string, description string")
    out = pipeline.evaluate_tfidf(cohort, cohort, "d")
    assert {r.band: r.n_pairs for r in out["level_means"].collect()} == {"top": 12, "middle": 12, "bottom": 12}
