"""All pairs by blocks against brute force, and what reports leave behind."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from prosemill.operators import cosines, vectors
from prosemill.plans import pipeline, queries
from pyspark.sql import functions as F

from .test_core import SF

SCHEMA = "cohort string, item string, v array<double>"


def _rows(seed=3):
    rng = random.Random(seed)
    rows = [(f"c{i % 2}", f"k{i:03d}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    rows += [(c, f"copy{i}", [1.0, 2.0, 3.0]) for i in range(9) for c in ("c0", "c1")]
    rows += [("c0", "zero", [0.0, 0.0, 0.0]), ("c0", "none", None), ("c0", "hole", [1.0, None, 2.0]), ("c0", "short", [1.0]), ("c0", "empty", [])]
    return [*rows, ("alone", "k1", [1.0, 2.0, 3.0]), (None, "k2", [1.0, 0.0, 0.0]), ("c1", None, [1.0, 0.0, 0.0])]


def _brute(rows):
    out = {}
    for cohort, i, a in rows:
        for other, j, b in rows:
            if cohort is not None and cohort == other and i is not None and j is not None and i < j:
                sim = 0.0
                if a and b and len(a) == len(b) and None not in a + b and any(a) and any(b):
                    sim = min(1.0, max(0.0, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))))
                out[cohort, i, j] = sim
    return out


@pytest.mark.parametrize("most", [7, 4096])
def test_blocks_are_brute_force(spark, most):
    rows = _rows()
    all_pairs = cosines.Cosines(spark.createDataFrame(rows, SCHEMA), "cohort", "item", "v", most)
    want = _brute(rows)
    got = all_pairs.pairs().collect()
    assert len(got) == len(want) and {(r.cohort, r.i, r.j): round(r.sim, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    for r in all_pairs.stats().collect():
        own = np.array([v for k, v in want.items() if k[0] == r.cohort])
        assert r.n_pairs == len(own) and np.allclose([r.mean_sim, r.std_sim, r.min_sim, r.max_sim], [own.mean(), own.std(), own.min(), own.max()])
    means = {(r.cohort, r.item): r.avg_similarity for r in all_pairs.per_item().collect()}
    assert len(means) == len(rows) and means["alone", "k1"] == 0
    for c, i, _ in rows:
        own = [v for k, v in want.items() if k[0] == c and i in k[1:]]
        assert abs(means[c, i] - (np.mean(own) if own else 0)) < 1e-12


@pytest.mark.parametrize("most", [7, 4096])
@pytest.mark.parametrize("n", [10, None, 100_000])
def test_bands_are_those_of_all_pairs_sorted(spark, most, n):
    rows = _rows(5)
    got = cosines.Cosines(spark.createDataFrame(rows, SCHEMA), "cohort", "item", "v", most).levels(n).collect()
    want = set()
    for cohort in ("c0", "c1"):
        order = sorted((-round(v, 9), i, j) for (c, i, j), v in _brute(rows).items() if c == cohort)
        size = min(n or sum(c == cohort and i is not None for c, i, _ in rows), len(order))
        for band, start in (("top", 0), ("middle", len(order) // 2), ("bottom", len(order) - size)):
            want |= {(cohort, band, p, i, j, -s) for p, (s, i, j) in enumerate(order[start : start + size])}
    assert len(got) == len(want) and {(r.cohort, r.band, r.place, r.i, r.j, round(r.sim, 9)) for r in got} == want


def _kept(spark, name):
    """Rows of the tables `name` in the shared folder."""
    found = glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{name}-*")
    return sum(spark.read.parquet(f).count() for f in found if os.path.exists(f"{f}/_SUCCESS"))


def test_equal_pairs_are_not_written_to_be_sorted(spark):
    """79,800 pairs of equal similarity: all were sorted and written for bands of 10."""
    items = spark.createDataFrame([("c", f"k{i:03d}", [1.0, 2.0]) for i in range(400)], SCHEMA)
    before = _kept(spark, "ranked")
    got = pipeline.reports(items.selectExpr("cohort as dataset", "item", "item as display", "1.0 as size"), cosines.Cosines(items, "cohort", "item", "v"))
    assert {r.band: r.n_pairs for r in got["level_means"].collect()} == {"top": 400, "middle": 400, "bottom": 400}
    assert _kept(spark, "ranked") - before <= 3 * 3 * 400


def test_names_that_a_store_lacks_need_no_pairs(spark):
    cohort = spark.createDataFrame([(f"g{i}", "none", "x", i) for i in range(5)], "generic_name string, drug_name string, description string, row_id long")
    store = spark.createDataFrame([(f"g{i}|g{i}", [1.0, float(i)]) for i in range(4)], "drug_name string, embedding array<double>")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    out = pipeline.evaluate(cohort, store, "d")
    assert [r.drug_name for r in out["missing"].collect()] == ["g4|g4"]
    assert set(os.listdir(folder)) == before  # bands of similarity were worked out for every report
    assert set(out) == {"pairs", "stats", "levels", "level_means", "marked", "per_item", "missing"}
    assert out["per_item"].count() == 4 and out["marked"].count() > 0


def test_ranges_of_sizes(spark):
    rows = [("c", "a", [1.0, 0.0]), ("c", "b", [0.0, 0.0])]
    items = spark.createDataFrame(rows, SCHEMA)
    sizes = spark.createDataFrame([("c", 1.0), ("c", 0.0)], "cohort string, size double")
    r = cosines.Cosines(items, "cohort", "item", "v").stats(sizes).first()
    assert (r.range_min, r.range_max) == (0.0, 1.0)
    assert vectors.pair_stats(cosines.Cosines(items, "cohort", "item", "v").pairs(), sizes).first().range_max == 1.0


def _block(n, seed):
    rng = np.random.default_rng(seed)
    held = pa.StructArray.from_arrays([pa.array(rng.permutation(n) * 2 + seed), pa.array(list(rng.normal(size=(n, 4))))], names=["item", "v"])
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held)


def test_products_are_made_in_small_tiles_and_once_a_pair():
    """A block with itself was multiplied whole, and by strips of 4 MB."""
    n = 3000
    own, two = cosines._Cell(_block(n, 0), None), cosines._Cell(_block(n, 0), _block(n, 1))
    sizes = [(t.sims.size, t.flat().size) for t in own.tiles()]
    assert max(s for s, _ in sizes) <= 1 << 16 and sum(s for s, _ in sizes) < 0.7 * n * n and sum(k for _, k in sizes) == n * (n - 1) // 2
    assert sum(t.flat().size for t in two.tiles()) == n * n


def test_pairs_of_a_band_are_worked_out_once(spark):
    """The sort by ranges took its sample from the products themselves."""
    items = spark.createDataFrame([("c", f"k{i:03d}", [1.0, float(i)]) for i in range(50)], SCHEMA)
    before = _kept(spark, "between")
    assert cosines.Cosines(items, "cohort", "item", "v").levels(10).count() == 30
    assert 30 <= _kept(spark, "between") - before <= 3 * (10 + 50)


def test_pairs_are_rounded_as_spark_rounds(spark):
    """Similarities were rounded row by row in decimals, which took longer than the products."""
    made = np.random.default_rng(3)
    values = np.concatenate([made.random(3000), made.integers(0, 10**7, 3000) / 10**7, np.arange(129) / 128, (made.integers(0, 10**6, 500) + 0.5) / 10**6, np.nextafter((np.arange(500) + 0.5) / 10**6, 0), [0.0, 1.0, 5e-7, 4.9999999999e-7, 1e-300]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert cosines._half_up(values, 6).tolist() == want
    items = spark.createDataFrame([(i % 2, i, made.integers(0, 3, 8).astype(float).tolist()) for i in range(60)], "c int, id long, v array<double>")
    of = cosines.Cosines(items, "c", "id", "v", most=7)
    assert sorted(of.pairs(6).collect()) == sorted(of.pairs().withColumn("sim", F.round("sim", 6)).collect())
    assert "round(" not in queries.QUERIES["cosine_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_for_each_cell(spark):
    """Each block was shuffled once for every block of its cohort, so disk grew with the square of the vectors."""
    made = np.random.default_rng(4).normal(size=(200, 3))
    items = spark.createDataFrame([("c", f"k{i:03d}", v.tolist()) for i, v in enumerate(made)], SCHEMA)
    of = cosines.Cosines(items, "cohort", "item", "v", most=10)
    cells = of._cells()
    n = of._stored.count()
    assert cells.count() == n * (n + 1) // 2 > 150
    assert {t for _, t in cells.dtypes} == {"string", "int"}  # names of files, no vectors
    assert of.pairs().count() == 199 * 100
