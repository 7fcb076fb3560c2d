"""Passages of 51 words at the edge of operator 6's window: counts by a plain search, without the package's code."""

import random

import pytest
from prosemill.llm import suffix_groups

from .conftest import docs

WINDOW = 400


def _passage(rng, size):
    """51 words that make `size` bytes."""
    letters = size - 50
    lengths = [letters // 51 + (i < letters % 51) for i in range(51)]
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in lengths)


def _removed(texts):
    """Bytes covered by a string of 400 bytes that starts at two places or more."""
    seen = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - WINDOW + 1):
            seen.setdefault(t[at : at + WINDOW], []).append((i, at))
    cover = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                cover[i].update(range(at, at + WINDOW))
    return [len(c) for c in cover]


@pytest.mark.parametrize(("size", "removed"), [(399, 0), (400, 400), (401, 401)])
def test_passage_of_51_words(spark, size, removed):
    """In two documents and twice in one; unlike letters stand on both sides, so that just the passage is shared."""
    rng = random.Random(size)
    across, within = _passage(rng, size), _passage(rng, size)
    assert len(across.split()) == 51 and len(across) == size
    texts = [
        "A" + across + "B" + _passage(rng, 900), _passage(rng, 500) + "C" + across + "D",
        "E" + within + "F" + _passage(rng, 300) + "G" + within + "H", _passage(rng, 2000), across[:-1],
    ]
    want = _removed([t.encode() for t in texts])
    assert want == [removed, removed, 2 * removed, 0, 0 if size < 401 else 400] and sum(want[:2]) == 2 * removed
    got = {r.id: r.n_removed for r in suffix_groups.remove_repeated_bytes(spark, docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
