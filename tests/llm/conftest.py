import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, id string, rid long, fp long, digest string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "k", "x", 1, 2, "d") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows, near copies, shared passages."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(60), say(120)
    near = base.split(" ")
    near[60] = "other"
    rows = [
        (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "One  two\tthree", "b"), (5, "One two three", None), (5, "One two three", None),
        (6, say(5000), "a"), (7, say(50) + " " + passage + " " + say(40), "b"), (8, say(30) + "\n" + passage + " " + say(70), "é"), (9, base, "a"), (10, " ".join(near), "a"),
        (11, "ÄÖ ß " + base.upper(), "c"), (None, "no identifier here", "a"), (12, "x" * 3000, "a"), (13, "a b", "b"), (14, "password = 'abcdefgh' AKIAABCDEFGHIJKL " + "0123456789abcdef" * 2, "b"),
        (15, (passage + " ") * 3, "b"), (16, base, "c"),
    ]
    return rows + [(100 + i, say(rng.randint(1, 200)), rng.choice("abc")) for i in range(60)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return docs(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return docs(spark, [])
