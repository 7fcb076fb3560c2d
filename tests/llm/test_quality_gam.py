"""The additive model: tables against a plain fit of one step, scores as sums of tables, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from prosemill.llm import quality_gam as G
from pyspark.sql import functions as F

from .conftest import docs


def _column(name, texts):
    return G.describe(pa.array(texts, pa.string()))[:, G.NAMES.index(name)].tolist()


def test_numbers_of_a_text():
    texts = ["The The cat!! sat|\n\nAB 12x, a\n12x, a", None, "", " \n\t", "x" * 50, "é é"]
    assert _column("words", texts) == [9, 0, 0, 0, 1, 2]
    assert _column("same_neighbour", texts)[0] == 1 / 9 and _column("same_neighbour", texts)[5] == 0.5
    assert _column("different_words", texts)[0] == 6 / 9 and _column("top_word", texts)[0] == 2 / 9
    assert _column("digit_words", texts)[0] == 2 / 9 and _column("capital_words", texts)[0] == 3 / 9
    assert _column("bars", texts)[0] == 1 / len(texts[0]) and _column("exclamations", texts)[0] == 2 / len(texts[0])
    assert _column("longest_word", texts)[4] == 50 and _column("line_words", texts)[0] == 3
    assert _column("same_lines", ["a b\nc\na b\n", "a"]) == [1 - 2 / 3, 0]
    assert _column("different_pairs", ["a b a b", "a"]) == [2 / 3, 0]
    assert (G.describe(pa.array([None, "", " "], pa.string())) == 0).all()


def test_a_text_has_the_same_numbers_in_any_block(monkeypatch, edge_rows):
    texts = pa.array([t for _, t, _ in edge_rows], pa.string())
    whole = G.describe(texts)
    single = np.concatenate([G.describe(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(whole, single)


def test_trees():
    g, h, n = np.array([1.0, 1, 1, -2, -2, 5]), np.ones(6), np.full(6, 50)
    step = G._tree(g, h, n)
    assert step.tolist() == [3 / 5] * 3 + [-4 / 4] * 2 + [5 / 3]
    assert len(set(G._tree(np.ones(4), np.ones(4), np.full(4, 50)).tolist())) == 1  # nothing to cut
    assert len(set(G._tree(g, h, np.full(6, 1)).tolist())) <= 1  # too few rows for a leaf
    square = np.zeros((4, 4))
    square[:2, :2], square[2:, 2:] = 1, 1
    square[:2, 2:], square[2:, :2] = -1, -1
    gain, step = G._quadrants(square, np.ones((4, 4)), np.full((4, 4), 50))
    assert gain > 0 and (np.sign(step) == np.sign(square)).all()


def test_pairs_learn_what_single_tables_cannot():
    """An exclusive or of two numbers: no single table separates it."""
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    label = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = G.fit(x, label)
    assert model.pairs[0][:2] == (3, 1)
    score = model.score(rng.random((10, 4)))
    assert ((score >= 0) & (score <= 1)).all()
    assert ((model.score(x) > 0.5) == (label == 1)).mean() > 0.97
    i = 5  # a score is the sum of its tables
    at = [int(np.searchsorted(e, x[i, f], "right")) for f, e in enumerate(model.edges)]
    total = model.bias + sum(t[b] for t, b in zip(model.single, at)) + sum(t[at[a] * G.PAIR_BINS // (len(model.edges[a]) + 1), at[b] * G.PAIR_BINS // (len(model.edges[b]) + 1)] for a, b, t in model.pairs)
    assert abs(1 / (1 + np.exp(-total)) - model.score(x[i : i + 1])[0]) < 1e-12


@pytest.fixture(scope="module")
def told():
    """Plain prose is good; shouted, repeated and barred text is not."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows, labels = [], []
    for i in range(400):
        said = [word() for _ in range(int(rng.integers(30, 90)))]
        good = i % 3 > 0
        kind = i % 2
        text = " ".join(said) + "." if good else " | ".join(said) if kind else " ".join([said[0]] * 60)
        rows.append((i, text, "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_rows(spark, told):
    rows, labels = told
    frame = docs(spark, rows)
    known = spark.createDataFrame([*labels, (0, None, 0), (None, 1, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = G.with_score(spark, frame, known, "quality_score").collect()
    out = [(r.doc_id, r.quality_score) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    want = dict((i, q) for i, q, _ in labels)
    assert len(out) > 50 and sum((s >= 0.5) == (want[i] == 1) for i, s in out) / len(out) > 0.95
    assert got[0].n == 7  # other columns stay
    again = G.with_score(spark, frame.repartition(7), known, "quality_score")
    assert {(r.doc_id, r.quality_score) for r in again.collect()} == {(r.doc_id, r.quality_score) for r in got}


def test_held_out_labels_are_not_learnt(spark, told):
    """Turning the held-out rows' labels round changes no score."""
    rows, labels = told
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    scores = [sorted((r.doc_id, r.s) for r in G.with_score(spark, docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int"), "s").collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_edges(spark, edge, empty, told):
    labels = spark.createDataFrame(told[1][:200], "doc_id long, quality int, toxic int")
    got = G.with_score(spark, edge, labels, "s")
    assert got.count() == edge.count() and got.filter("s is null or s < 0 or s > 1").count() == 0
    texts = got.filter("text is null or trim(text) = ''").select("s").distinct()
    assert texts.count() == 1
    assert G.with_score(spark, edge, labels.limit(0), "s").filter("s <> 0.5").count() == 0
    assert G.with_score(spark, empty, labels, "s").count() == 0
    with pytest.raises(ValueError, match="column"):
        G.with_score(spark, edge.withColumn("score", F.lit(1)), labels)
