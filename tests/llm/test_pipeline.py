"""The pipeline on a small corpus with planted cases, each stage against a plain count of its own; and op4 against a plain loop."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from prosemill.llm import common, toxicity

from .test_whole_jobs import _components, _sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the identifiers planted in it."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels, planted = [], [], defaultdict(set)

    def add(kind, text):
        rows.append((len(rows), text if text is None or isinstance(text, str) else " ".join(text), "en", rng.choice(["a", "b", None, "é"]), 1))
        planted[kind].add(len(rows) - 1)

    for i in range(900):
        toxic = int(i % 6 == 0)
        add("toxic" if toxic else "clean", say(40) + ["vile"] * toxic)
        if i < 800:
            labels.append((i, 1, toxic))
    for _ in range(8):
        one = say(60)
        add("clean", one)
        add("exact", "  ".join(one[:30]) + " \n" + " ".join(one[30:]))
    for _ in range(8):
        one = say(200)
        add("clean", one)
        for _ in range(2):
            near = list(one)
            near[rng.randrange(200)] = "other"
            add("near", near)
    items = [say(50) for _ in range(6)]
    for item in items:
        add("leak", say(100) + item[5:30] + say(100))
        add("clean", say(100) + item[:7] + say(100))  # too short to be a window
    add("leak", say(150) + items[0][:8] + say(50) + items[1][20:28])
    add("clean", None)
    add("exact", "")
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), planted, items


def _leaks(rows, items):
    """Rows with windows of two items, or a run of 13 words of one, or half of the row or item."""
    out = set()
    for i, t in rows:
        w = BENCH_WORD.findall((t or "").lower())
        hit, by = set(), defaultdict(set)
        for n, item in enumerate(items):
            windows = {tuple(item[j : j + 8]) for j in range(len(item) - 7)}
            for j in range(len(w) - 7):
                if tuple(w[j : j + 8]) in windows:
                    by[n] |= set(range(j, j + 8))
        for spots in by.values():
            hit |= spots
        runs = [max(len(list(g)) for g in _runs(sorted(s))) for s in by.values()]
        if len(by) >= 2 or any(r >= 13 for r in runs) or (hit and 2 * len(hit) >= len(w)):
            out.add(i)
    return out


def _runs(spots):
    run = [spots[0]]
    for a, b in zip(spots, spots[1:]):
        if b != a + 1:
            yield run
            run = []
        run.append(b)
    yield run


def test_stages_on_planted_cases(spark, corpus):
    folder, planted, items = corpus
    scratch, docs, kept = common.Scratch(spark), common.table(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = scratch.write(stage(spark, docs, folder), name)
        kept[name] = docs.collect()
        assert name == "mixing" or docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    everything = set(range(max(map(max, planted.values())) + 1))
    # toxicity: all planted ones go, and of the clean ones not one in a hundred
    lost = everything - ids["toxicity"] - planted["toxic"]
    assert not planted["toxic"] & ids["toxicity"] and len(lost) <= 0.01 * len(planted["clean"])
    planted = {kind: found - lost for kind, found in planted.items()}
    # exact: one row of each normalised text, the smallest identifier
    least = {}
    for r in sorted(kept["toxicity"], key=lambda r: r.doc_id):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert ids["exact_dedup"] == set(least.values())
    assert ids["toxicity"] - ids["exact_dedup"] == planted["exact"]
    # near: one row of each component of texts at 0.8 or more of 5-word shingles
    before = sorted(kept["exact_dedup"], key=lambda r: r.doc_id)
    name = _components(_sets([r.text for r in before]))
    assert ids["near_dedup"] == {before[c].doc_id for c in set(name)}
    assert ids["exact_dedup"] - ids["near_dedup"] == planted["near"]
    # decontamination: an independent count, and it is no no-op
    gone = _leaks([(r.doc_id, r.text) for r in kept["near_dedup"]], items)
    assert ids["near_dedup"] - ids["decontamination"] == gone == planted["leak"]
    assert ids["decontamination"] == planted["clean"]
    # mixing: all that was kept, sources near their targets
    assert ids["mixing"] == ids["decontamination"]
    source, taken, size = {r.doc_id: r.source for r in kept["decontamination"]}, Counter(), Counter()
    for r in kept["mixing"]:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
    for r in kept["mixing"]:
        assert abs(taken[source[r.doc_id]] - r.target) <= 1 and r.source_size == size[source[r.doc_id]]
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size)


def test_run_is_the_stages(spark, corpus):
    folder, planted, _ = corpus
    got = {r.doc_id for r in P.run(spark, folder).collect()}
    assert got <= planted["clean"] and len(got) >= 0.99 * len(planted["clean"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_ftrl_is_the_plain_loop(spark):
    """Weights and scores against FTRL-proximal written out, one feature at a time."""
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) + (" Foul!" if i % 3 == 0 else "")) for i in range(300)]
    label = {i: int(i % 3 == 0) for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    got = toxicity.train(spark, docs, labels, toxicity.fold(toxicity.F.col("id")) != 2)

    def places(text):
        """Hashed words and pairs at distances 1 to 3, each once."""
        import pyarrow as pa

        (_, at, _, count), *more = toxicity.features(pa.array([text])) if text else [(0, [], [], [0])]
        n = len(re.findall(r"[0-9A-Za-z\x80-\xff]+", text))
        assert not more and count[0] == n and len(at) == sum(max(0, n - d) for d in range(4))
        return sorted(set(int(x) for x in at)), n

    order = [r.doc_id for r in docs.filter(toxicity.fold(toxicity.F.col("doc_id")) != 2).orderBy(toxicity.F.xxhash64(toxicity.F.lit(7), "doc_id")).collect()]
    text, z, n2, bias = dict(rows), defaultdict(float), defaultdict(float), [0.0, 0.0]

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n2[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            at, n = places(text[i])
            x = toxicity.SCALE / max(n, 1) ** toxicity.POWER
            w = {k: weight(k) for k in at}
            wb = -bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA)
            error = 1 / (1 + math.exp(-(x * sum(w.values()) + wb))) - label[i]
            for k in at:
                g = error * x
                z[k] += g - (math.sqrt(n2[k] + g * g) - math.sqrt(n2[k])) / toxicity.ALPHA * w[k]
                n2[k] += g * g
            bias[0] += error - (math.sqrt(bias[1] + error**2) - math.sqrt(bias[1])) / toxicity.ALPHA * wb
            bias[1] += error**2
    want = {k: weight(k) for k in z if weight(k)}
    assert want and {int(k): pytest.approx(v) for k, v in want.items()} == {int(k): got[k] for k in got[:-1].nonzero()[0]}
    assert got[-1] == pytest.approx(-bias[0] / ((toxicity.BETA + math.sqrt(bias[1])) / toxicity.ALPHA))
    scored = docs.withColumn("s", toxicity.scorer(spark, got)("text")).collect()
    for r in scored:
        at, n = places(r.text)
        assert r.s == pytest.approx(1 / (1 + math.exp(-(toxicity.SCALE / max(n, 1) ** toxicity.POWER * sum(want.get(k, 0.0) for k in at) + got[-1]))))
