"""Jobs that were done in part before: each test failed on the code of round 1."""

import random
from collections import defaultdict

import corpus_pipeline as P
from prosemill.llm import decontaminate, near_copies, simhash

from .conftest import docs


def _sets(texts):
    def one(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return frozenset(" ".join(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])

    return [one(t) for t in texts]


def _components(sets):
    name = list(range(len(sets)))
    near = [[j for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0] for a in sets]
    for _ in name:
        name = [min(name[j] for j in near[i]) for i in range(len(sets))]
    return name


def test_near_stage_reaches_similarity(spark):
    """Copies with some words changed differ in more than 4 bits of a SimHash; the stage keeps one of them."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(900)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(5):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append((100 * g + c, " ".join(text), "a"))
    rows += [(5000, None, "a"), (5001, "", "a"), (5002, "One two", "a"), (5003, "one TWO", "a")]
    frame = docs(spark, rows)
    name = _components(_sets([t for _, t, _ in rows]))
    got = {r.id: r.component for r in near_copies.near_copies(spark, frame).collect()}
    assert got == {i: rows[c][0] for (i, _, _), c in zip(rows, name, strict=True)}
    assert simhash.near_duplicates(spark, frame).select("component").distinct().count() > len(set(name))
    kept = P.drop_near_copies(spark, frame, "")
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_near_copies_on_edges(spark, edge, empty, edge_rows):
    name, least = _components(_sets([t for _, t, _ in edge_rows])), defaultdict(list)
    for (i, _, _), c in zip(edge_rows, name, strict=True):
        least[c].append(i)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in least.items()}
    key = lambda p: (p[0] is None, p[0] or 0)
    got = sorted(((r.id, r.component) for r in near_copies.near_copies(spark, edge).collect()), key=key)
    assert got == sorted(((i, least[c]) for (i, _, _), c in zip(edge_rows, name, strict=True)), key=key)
    assert near_copies.near_copies(spark, empty).count() == 0


def test_decontamination_stage_drops_leaks_of_one_item(spark):
    rng = random.Random(12)
    say = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    item, brief, long = say(60), say(10), say(40)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(brief)), (3, "tiny item"), (4, " ".join(long))], "item_id long, text string")
    texts = {1: say(40) + item + say(40), 2: say(90) + item[5:18] + say(90), 3: say(90) + item[5:17] + say(90), 4: say(90) + brief + say(20), 5: say(3) + item[30:40] + say(3), 6: say(99), 7: say(9) + ["tiny", "item"] + say(9), 8: say(99) + item[:8] + say(9) + long[:8], 9: say(200) + item[:9] + say(9) + item[20:29]}
    frame = docs(spark, [(i, " ".join(w), "a") for i, w in texts.items()])
    kept = decontaminate.keep_uncontaminated(spark, frame, items)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {3, 6, 7, 9}


def test_null_item_counts(spark):
    """A null identifier is an item of its own, as in the query's SQL."""
    one, two = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(1, one), (None, two)], "item_id long, text string")
    frame = docs(spark, [(1, f"{one} and {two}", "a"), (2, two, "a"), (3, "neither", "a")])
    got = {r.id: r["items"] for r in decontaminate.contamination(spark, frame, items).collect()}
    assert got == {1: ["1", None], 2: [None], 3: []}
