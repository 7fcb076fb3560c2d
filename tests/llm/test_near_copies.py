"""The pipeline's near copies by SimHash: bits against a plain majority, candidates against all pairs of fingerprints."""

import random
import zlib

import numpy as np
from prosemill.llm import common, near_copies


def _mixed(x):
    """The splitmix64 finaliser on a plain number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def _group(rng, centre, n, flips):
    """Fingerprints that differ from the centre in up to so many of 512 bits."""
    return [centre ^ sum(1 << b for b in rng.sample(range(512), rng.randrange(flips))) for _ in range(n)]


def _parts(fps):
    """Components of fingerprints with three neighbouring words that differ in few enough bits."""
    words = [[x >> 64 * w & 2**64 - 1 for w in range(8)] for x in fps]
    near = lambda a, b: any(sum((a[(w + i) % 8] ^ b[(w + i) % 8]).bit_count() for i in range(3)) <= near_copies.NEAR for w in range(8))
    name = list(range(len(fps)))
    links = [[j for j, b in enumerate(words) if near(a, b)] for a in words]
    while (new := [min(name[j] for j in links[i]) for i in range(len(fps))]) != name:
        name = new
    return name


def _table(spark, fps):
    signed = lambda x: x - 2**64 if x >> 63 else x
    return spark.createDataFrame([(i, 5, [signed(x >> 64 * w & 2**64 - 1) for w in range(8)]) for i, x in enumerate(fps)], "fp long, size long, bits array<long>")


def test_fingerprints_are_majorities():
    rng = random.Random(1)
    found = [[rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 7, 400, 70_000, 3)]
    got = near_copies.fingerprints([np.array(x, np.uint64) for x in found])
    assert got.shape == (7, near_copies.WORDS)
    for x, row in list(zip(found, got))[:5] + [(found[6], got[6])]:
        for word, bits in enumerate(row.tolist()):
            h = [_mixed(y ^ _mixed(word + 1)) for y in x]
            assert bits == sum(1 << b for b in range(64) if 2 * sum(y >> b & 1 for y in h) > len(h))
    one = [_mixed(y ^ _mixed(1)) for y in found[5]]  # more than a block of hashes
    assert all(int(got[5, 0]) >> b & 1 == (2 * sum(y >> b & 1 for y in one) > len(one)) for b in range(0, 64, 9))


def test_candidates_are_all_near_fingerprints(spark, monkeypatch):
    """Also in anchors of many blocks, and where the first round has connected a part of a group."""
    rng = random.Random(zlib.crc32(b"near"))
    fps = [x for _ in range(12) for x in _group(rng, rng.getrandbits(512), rng.randrange(1, 15), 40)] + _group(rng, rng.getrandbits(512), 150, 30)
    want = _parts(fps)
    assert 1 < len(set(want)) < len(fps) - 100
    for crowded in (False, True):
        if crowded:
            for name, value in (("HOMES", 5), ("ROWS", 11), ("COUNTED", 1)):
                monkeypatch.setattr(near_copies, name, value)
        stars, _ = near_copies.candidates(spark, _table(spark, fps), common.Scratch(spark))
        root = {r.v: r.root for r in stars.collect()}
        got = [root.get(i, i) for i in range(len(fps))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_chains_of_near_copies(spark):
    """Texts that are near copies of a neighbour only, and many copies of one text with a few words changed."""
    rng = random.Random(9)
    words = [f"c{i}" for i in range(5000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    chain = [say(200)]
    for i in range(30):
        chain.append([*chain[-1][:6 * i], *say(3), *chain[-1][6 * i + 3 :]])
    base, many = say(390), []
    for _ in range(120):
        one = list(base)
        for _ in range(rng.randrange(4, 9)):
            one[rng.randrange(390)] = rng.choice(words)
        many.append(one)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain + many + [say(150) for _ in range(100)])]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    name = list(range(len(rows)))
    links = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    while (new := [min(name[j] for j in links[i]) for i in range(len(rows))]) != name:
        name = new
    assert len(set(name)) < len(rows) - 50
    got = {r.id: r.component for r in near_copies.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(name))


def test_unlike_words_of_one_hash_stay_apart(spark):
    """Words whose polynomial hashes are equal for every base, alone and among others, and real copies beside them."""
    from .conftest import docs
    from .test_operators import _twins

    one, two = _twins()
    side = [f"s{i}" for i in range(40)]
    rows = [(1, one, "a"), (2, two, "a"), (3, " ".join([*side[:20], one]), "a"), (4, " ".join([*side[:20], two]), "a"), (5, one.upper(), "a"), (6, f"{two}  ", "b"), (7, "s1 s2", "a"), (8, "s1  s2", "a"), (9, None, "a"), (10, " ", "a")]
    got = {r.id: r.component for r in near_copies.near_copies(spark, docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1, 6: 2, 7: 7, 8: 7, 9: 9, 10: 9}
    assert sorted(r.doc_id for r in near_copies.keep_one(spark, docs(spark, rows)).collect()) == [1, 2, 3, 7, 9]
