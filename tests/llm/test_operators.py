"""Every operator against brute force on edge cases, on an empty table, and on the smallest data."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from prosemill.llm import chat, common, decontaminate, exact_dedup, fm_index, mixing, secrets, simhash, suffix_groups, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, edge, empty, edge_rows):
    got = exact_dedup.exact_dedup(spark, edge).collect()
    groups = defaultdict(list)
    for i, t, _ in edge_rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = Counter((i, min(x for x in ids if x is not None) if any(x is not None for x in ids) else None, len(ids)) for ids in groups.values() for i in ids)
    assert Counter((r.id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep_first(spark, edge).count() == len(groups)
    assert exact_dedup.exact_dedup(spark, empty).count() == 0 == exact_dedup.keep_first(spark, empty).count()


def test_exact_dedup_collision(spark, edge, monkeypatch):
    """All digests equal: byte verification has to tell the texts apart."""
    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: exact_dedup.F.unhex(exact_dedup.F.sha2(exact_dedup.F.substring(norm, 1, 0), 256)))
    want = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in edge.select("text").collect()}
    assert exact_dedup.exact_dedup(spark, edge).filter("kept").count() == len(want)


def test_index_in_three_rounds(spark, edge):
    """Append, compact, append, compact, append, compact is one pass; look-ups in between find what was appended."""
    index = exact_dedup.DigestIndex(common.Scratch(spark))
    parts = [edge.filter("doc_id < 9"), edge.filter("doc_id between 9 and 120"), edge.filter("doc_id > 120 or doc_id is null")]
    for i, part in enumerate(parts):
        log = index.append(part, "doc_id", "text")
        if i == 1:  # document 16 repeats 9: in one run now
            assert {r.keep.id for r in index.probe(log).filter("n > 1").collect()} == {9}
            assert len(index.runs) == 2
        merged = index.compact()
        assert len(index.runs) == 1
    once = exact_dedup.DigestIndex(common.Scratch(spark))
    once.append(edge, "doc_id", "text")
    key = lambda df: sorted((bytes(r.digest), r.n, repr(r.keep.id)) for r in df.collect())
    assert key(merged) == key(once.compact())
    unknown = spark.createDataFrame([(bytearray(32),)], "digest binary")
    assert index.probe(unknown).count() == 0


def test_exact_dedup_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (None, "a", 6, "y"), (None, "b", 7, "z")], "doc_id long, text string, _id int, _digest string")
    got = exact_dedup.keep_first(spark, rows)
    assert got.schema == rows.schema and sorted((r._id, r._digest) for r in got.collect()) == [(5, "x"), (7, "z")]


def test_index_takes_batches(spark, edge):
    index = exact_dedup.DigestIndex(common.Scratch(spark))
    index.append(edge.filter("doc_id < 10"), "doc_id", "text")
    index.append(edge.filter("doc_id >= 10 or doc_id is null"), "doc_id", "text")
    merged = index.compact()
    assert merged.agg({"n": "sum"}).first()[0] == edge.count()
    assert merged.filter("n > 1 and keep.id = 9").count() == 1


def _brute_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    said = {c: [v[2:] for v in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c, turns in said.items():
        over = [d for d, more in said.items() if more[: len(turns)] == turns]
        out[c] = min(over, key=lambda d: (-len(said[d]), d is None, d or 0))
    return out


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", None), (4, 0, "user", ""), (5, 0, "user", "a"), (5, 1, "bot", "b"), (5, 2, None, "c"), (6, 0, "user", "a"), (6, 1, "bot", "b"), (7, 3, "x", "same"), (8, 9, "x", "same"), (None, None, None, None), (9, 0, "r", "t"), (9, 0, "r", "t")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    got = {r.conv_id: r for r in chat.chat_format(spark, frame).collect()}
    assert {c: r.keep_id for c, r in got.items()} == _brute_chat(rows)
    assert got[5].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>\nc<|im_end|>\n"
    assert got[2].rendered is None and chat.chat_format(spark, frame.limit(0)).count() == 0


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 1000), ("d", 10), (None, 5), ("é", 0)]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted([s for s, _ in rows if s is not None]) + [None]
    size = dict(rows)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * weight[s] / open_weight > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert got[s].target == pytest.approx(3 * size[s] if s in capped else rest * weight[s] / open_weight)


def test_mixing(spark, edge, empty, edge_rows, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    got = mixing.mix(spark, edge).collect()
    assert Counter((r.id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in edge_rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.taken - r.copies * r.size <= r.size
        by[r.target].append(r)
    for target, rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= 1  # one source each, whole words
        assert sum(r.taken != r.copies * r.size for r in rows) <= 1
    again = mixing.mix(spark, edge.repartition(7)).collect()
    assert Counter((r.id, r.taken) for r in got) == Counter((r.id, r.taken) for r in again)
    assert mixing.mix(spark, empty).count() == 0


def test_toxicity(spark, edge, empty):
    rng = random.Random(1)
    rows = [(i, " ".join([rng.choice(["fine", "day", "tree", "house"]) for _ in range(40)] + ["vile"] * (i % 2)), i % 2) for i in range(600)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = train.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    weights = toxicity.train(spark, train.select("doc_id", "text"), labels, toxicity.fold(toxicity.F.col("id")) != 2)
    score = toxicity.scorer(spark, weights)
    held = train.filter(toxicity.fold(toxicity.F.col("doc_id")) == 2).withColumn("s", score("text")).collect()
    assert all((r.s >= 0.3) == bool(r.toxic) for r in held)
    assert np.count_nonzero(weights) < 100
    # a long text does not hide what a short one shows, and repeating a word adds nothing
    bad = next(r.text for r in held if r.toxic)
    texts = spark.createDataFrame([(bad,), (f"{bad} {bad}",)], "text string").select("text", score("text").alias("s")).collect()
    assert all(r.s >= 0.3 for r in texts)
    assert toxicity.with_score(spark, edge, labels).filter("score between 0 and 1").count() == edge.count()
    assert toxicity.keep_clean(spark, empty, labels).count() == 0
    assert toxicity.with_score(spark, edge, labels.limit(0)).filter("score = 0.5").count() == edge.count()


def _covered(items, window):
    seen = Counter(tuple(x[j : j + window]) for x in items for j in range(len(x) - window + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for j in range(len(x) - window + 1):
            if seen[tuple(x[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append(gone)
    return out


def test_substring_dedup(spark, edge, empty, edge_rows):
    items = [WORD.findall(t or "") for _, t, _ in edge_rows]
    want = Counter((i, len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for (i, _, _), w, g in zip(edge_rows, items, _covered(items, fm_index.WINDOW)))
    got = fm_index.remove_repeated_windows(spark, edge).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert sum(r.n_removed for r in got) > 100
    assert fm_index.remove_repeated_windows(spark, empty).count() == 0


def test_suffix_dedup(spark, empty, edge_rows):
    from .conftest import docs

    rows = [(i, t and t.replace(" ", "_-=-_"), s) for i, t, s in edge_rows]  # long enough for windows of 400 bytes
    items = [(t or "").encode() for _, t, _ in rows]
    want = Counter((i, len(b), sum(g), bytes(x for x, y in zip(b, g) if not y)) for (i, _, _), b, g in zip(rows, items, _covered(items, suffix_groups.WINDOW)))
    got = suffix_groups.remove_repeated_bytes(spark, docs(spark, rows)).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want
    assert sum(r.n_removed for r in got) > 2000
    assert suffix_groups.remove_repeated_bytes(spark, empty).count() == 0


def _twins():
    """Two different words of 2,048 letters whose polynomial hashes modulo 2**64 are equal for every base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_words_of_one_hash(spark):
    from .conftest import docs

    one, two = _twins()
    side = [f"s{i}" for i in range(60)]
    rows = [(1, " ".join([*side[:17], one, *side[17:34]]), "a"), (2, " ".join([*side[:17], two, *side[17:34]]), "a")]
    assert {r.n_removed for r in fm_index.remove_repeated_windows(spark, docs(spark, rows)).collect()} == {0}
    texts = [(1, one, "a"), (2, two, "a"), (3, "-" + one[:300] + "=" * 120, "a"), (4, "+" + two[:300] + "=" * 120, "a")]
    items = [t.encode() for _, t, _ in texts]
    want = {i: sum(g) for (i, _, _), g in zip(texts, _covered(items, suffix_groups.WINDOW), strict=True)}
    assert {r.id: r.n_removed for r in suffix_groups.remove_repeated_bytes(spark, docs(spark, texts)).collect()} == want


@pytest.mark.parametrize("by_word", [True, False])
def test_hot_keys_are_split(spark, monkeypatch, by_word):
    """A passage that stands in many contexts makes one key with many different segments; results do not change."""
    from prosemill.llm import repeats

    from .conftest import docs

    monkeypatch.setattr(repeats, "HOT", 3)
    rng = random.Random(8)
    say = lambda n: [f"{rng.randrange(10**7):07d}" for _ in range(n)]
    passage, sides = say(30), [say(24) for _ in range(4)]
    rows = []
    for i in range(40):  # some contexts share a part of their words next to the passage
        before, after = rng.choice(sides)[rng.randrange(24) :], rng.choice(sides)[: rng.randrange(24)]
        rows.append((i, " ".join(say(rng.randint(0, 30)) + before + passage + after + say(rng.randint(0, 30))), "a"))
    if by_word:
        items, op, window = [t.split(" ") for _, t, _ in rows], fm_index.remove_repeated_windows, fm_index.WINDOW
    else:
        items, op, window = [t.encode() for _, t, _ in rows], suffix_groups.remove_repeated_bytes, suffix_groups.WINDOW
    want = {i: sum(g) for (i, _, _), g in zip(rows, _covered(items, window), strict=True)}
    got = {r.id: r.n_removed for r in op(spark, docs(spark, rows)).collect()}
    assert got == want and (sum(want.values()) > 0)


def test_texts_beyond_a_block(spark):
    """Documents longer than a block of bytes, with a passage in common."""
    from .conftest import docs

    rng = random.Random(9)
    say = lambda n: " ".join(f"{rng.randrange(10**8)}" for _ in range(n))
    passage = say(60)
    rows = [(1, say(130_000) + " " + passage + " " + say(10), "a"), (2, passage + " " + say(120_000), "a"), (3, say(50), "a")]
    got = {r.id: (r.n_words, r.n_removed) for r in fm_index.remove_repeated_windows(spark, docs(spark, rows)).collect()}
    assert got == {1: (130_070, 60), 2: (120_060, 60), 3: (50, 0)}
    got = {r.id: r.n_removed for r in suffix_groups.remove_repeated_bytes(spark, docs(spark, rows)).collect()}
    assert got[3] == 0 and got[1] == got[2] and len(passage) <= got[1] <= len(passage) + 2


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_groups.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("resolve", [fm_index.repeated_windows, suffix_groups.repeated_windows])
def test_index_counts_multiplicities(resolve):
    """A segment that stands twice is one row with m = 2: all its windows repeat; alone, none does."""
    text = b" ".join(b"w%07d" % i for i in range(55))  # 55 words, 494 bytes
    n = {fm_index.repeated_windows: 21, suffix_groups.repeated_windows: 95}[resolve]
    for m in (1, 2):
        got = list(resolve([{"key": 1, "seg": b"s", "m": m, "n": n, "anchor": 3, "text": text}]))
        assert [(i, mask.tolist()) for i, mask in got] == ([(0, [True] * n)] if m == 2 else [])


def test_decontamination(spark, edge, empty, edge_rows):
    long = edge_rows[5 + 3][1].split()
    tests = spark.createDataFrame([(1, " ".join(long[32:50]), 1), (2, " ".join(long[40:49]).upper(), 1), (3, "a b", 1), (4, None, 1), (5, "", 1), (6, "not there at all", 1), (7, " ".join(long[60:68]), 1)], "item_id long, text string, fp int")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for r in tests.collect():
        w = split(r.text)
        for j in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[j : j + 8])].add(str(r.item_id))
    want = Counter()
    for i, t, _ in edge_rows:
        w, hit, items = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        want[i, len(w), len(hit), ",".join(sorted(items))] += 1
    got = decontaminate.contamination(spark, edge, tests)
    assert Counter((r.id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == want
    assert decontaminate.contamination(spark, empty, tests).count() == 0
    assert decontaminate.contamination(spark, edge, tests.limit(0)).filter("n_hit > 0").count() == 0


def test_simhash(spark, edge, empty, edge_rows):
    fps = []
    for _, t, _ in edge_rows:
        w = WORD.findall(lower(t))
        s = [" ".join(w[j : j + 4]) for j in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    name = list(range(len(fps)))
    for _ in name:
        name = [min(name[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    least = defaultdict(list)
    for (i, _, _), c in zip(edge_rows, name):
        least[c].append(i)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in least.items()}
    got = simhash.near_duplicates(spark, edge).collect()
    assert Counter((r.id, r.fp % 2**64, r.component) for r in got) == Counter((i, f, least[c]) for (i, _, _), f, c in zip(edge_rows, fps, name))
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_golay_covers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    y = x ^ (1 << rng.integers(0, 23, 2000))
    home, _ = simhash.anchors(x)
    at, more = simhash.anchors(y)
    assert (np.bitwise_count(home ^ x) <= 3).all()
    assert ((at == home) | (more == home[:, None]).any(axis=1)).all()


def test_chains_and_crowded_anchors(spark, monkeypatch):
    """A chain of fingerprints is one component, also when anchors are split into blocks."""
    monkeypatch.setattr(simhash, "HOMES", 2)
    rng, chain = random.Random(2), [rng_start := 123456789]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in {x % 2**64 for x in chain}], "fp long")
    scratch = common.Scratch(spark)
    stars = simhash.components(spark, simhash.near_links(spark, rows, scratch), scratch)
    assert stars.select("root").distinct().count() == 1 and stars.count() == rows.count() - 1 and rng_start


def test_token_counts(spark, edge, empty, edge_rows):
    lengths = [len(token_counts.encoding().encode_ordinary(t or "")) for _, t, _ in edge_rows]
    answers = token_counts.limits(token_counts.length_histogram(edge))
    for r in answers.collect():
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.n_docs == lengths.count(r.n_tokens) and r.docs_up_to == sum(x <= r.n_tokens for x in lengths)
    assert token_counts.truncated_total(answers, 77).first()[0] == sum(min(x, 77) for x in lengths)
    assert token_counts.quantile(answers, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.limits(token_counts.length_histogram(empty)).count() == 0


def test_token_counts_of_long_white_space():
    encoder, rng = token_counts.encoding(), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", " be", "1", ".", "\x1c", "\u3000", " ", "  ", "\n", " \t\r\n ", "'s"]) for _ in range(rng.randint(0, 25)))
        assert token_counts.count_tokens(encoder, text, 2) == len(encoder.encode_ordinary(text))
    assert token_counts.count_tokens(encoder, "a" + " \n" * 1_000_000 + "b") > 2


def test_stages_tell_rows_without_identifier_apart(spark):
    """Missing and repeated identifiers: each row is judged by its own text, and one of each group stays."""
    from .conftest import docs

    say = lambda seed, n: " ".join(random.Random(seed).choice("abcdefghij") * 3 + str(i % 7) for i in range(n))
    one, two, three = say(1, 200), say(2, 200), say(3, 200)
    near = one.replace("0", "0 ", 1)  # equal words, another text
    rows = [(None, one, "a"), (4, one, "a"), (None, two, "a"), (None, two, "a"), (7, three, "a"), (7, "something else", "a"), (None, near + " ", "a")]
    table = docs(spark, rows)
    exact = exact_dedup.keep_first(spark, table)
    assert exact.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted([(4, one), (0, two), (7, three), (7, "something else"), (0, near + " ")])
    kept = simhash.keep_one(spark, table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(4, one), (0, two), (7, three), (7, "something else")])
    items = spark.createDataFrame([(1, " ".join(three.split(" ")[20:60])), (2, " ".join(three.split(" ")[100:140])), (3, two), (4, two)], "item_id long, text string")
    clean = decontaminate.keep_uncontaminated(spark, table, items)
    assert clean.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted([(0, one), (4, one), (7, "something else"), (0, near + " ")])


def test_secrets(spark, edge, empty, edge_rows, tmp_path):
    got = secrets.secret_scan(spark, edge).collect()
    assert len(got) == len(edge_rows)
    text = next(t for i, t, _ in edge_rows if i == 14)
    spans = next(r.spans for r in got if r.id == 14)
    assert [(s.rule, text[s.start : s.end]) for s in spans] == [("assign", "password = 'abcdefgh"), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0123456789abcdef" * 2)]
    assert secrets.secret_scan(spark, empty).count() == 0
    # a second run over the same ledger scans only new pairs
    path = str(tmp_path / "ledger")
    secrets.secret_scan(spark, edge, rules=secrets.BASE, ledger=path)
    before = spark.read.parquet(path).count()
    secrets.secret_scan(spark, edge, rules=secrets.RULES, ledger=path)
    after = spark.read.parquet(path)
    assert after.count() == before // 3 * 5 == after.select("blob", "rule", "version").distinct().count()
    # rows that a false positive of the filter appends again do not double findings
    once = sorted(map(repr, secrets.secret_scan(spark, edge, ledger=path).collect()))
    spark.createDataFrame(after.collect(), after.schema).write.mode("append").parquet(path)
    assert sorted(map(repr, secrets.secret_scan(spark, edge, ledger=path).collect())) == once


@pytest.mark.parametrize("module", [exact_dedup, chat, decontaminate, secrets])
def test_oracles(spark, module):
    import os

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    name = next(n for n in dir(module) if re.match(r"op\d+_", n))
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()))
    assert rows(getattr(module, name)(spark, SF).toPandas()) == rows(db.sql(module.ORACLE).df())


def test_digest_columns(spark):
    out = fm_index.op5_substring_dedup(spark, SF).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    for r in out:
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(texts[r.doc_id] or "")).encode()).hexdigest()


def test_crowded_anchors_lose_no_link(spark, monkeypatch):
    """Fingerprints that share whole pieces crowd their anchors; components are those of all pairs."""
    monkeypatch.setattr(simhash, "HOMES", 3)
    monkeypatch.setattr(simhash, "ROWS", 12)
    rng = random.Random(6)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        if rng.random() < 0.7:
            centre = centre & ~0x7FFFFF | 0x155555  # one word in the first piece
        if rng.random() < 0.5:
            centre = centre & (1 << 46) - 1 | 5 << 46  # and in the last
        for _ in range(10):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    name = list(range(len(fps)))
    near = [[j for j, b in enumerate(fps) if (a ^ b).bit_count() <= 4] for a in fps]
    for _ in name:
        name = [min(name[j] for j in near[i]) for i in range(len(fps))]
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    scratch = common.Scratch(spark)
    stars = {r.v % 2**64: r.root % 2**64 for r in simhash.components(spark, simhash.near_links(spark, rows, scratch), scratch).collect()}
    got = [stars.get(x, x) for x in fps]
    assert len(set(zip(got, name))) == len(set(got)) == len(set(name)) < len(fps)
