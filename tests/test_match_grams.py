"""Names that no component can meet are left out early."""

import random

import pytest
from prosemill.operators import match


@pytest.mark.parametrize("most", [match.MOST_GRAMS, 0])
def test_names_without_grams_of_components_are_not_shuffled(spark, monkeypatch, most):
    """All names were made distinct, shuffled and dealt by grams, also those that share none with any component."""
    monkeypatch.setattr(match, "MOST_GRAMS", most)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = [say(rng.randint(1, 9)) for _ in range(300)] + ["never met", "xyzxyz", None]
    products = [(i, f"{say(rng.randint(2, 8))} / {say(rng.randint(4, 12))}") for i in range(30)]
    dictionary = spark.createDataFrame([(x,) for x in names * 2], "name_key string").repartition(3).distinct()
    got = match.component_substring(spark.createDataFrame(products, "row_id long, generic_name string"), dictionary)
    want = {(i, pos, x) for i, g in products for pos, c in enumerate(g.split(" / ")) if len(c) >= 4 for x in names if x and len(x) >= 4 and (x in c or c in x)}
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [name_key") :]  # the distinct names and what they are made of
    assert ("exists(" in below) == bool(most)
