"""Token alignment against a plain walk over whole encodes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from prosemill.llm import token_align as T

from .conftest import docs


@pytest.fixture(scope="module")
def plain():
    """Whole texts encoded by both libraries, and the bytes of each id."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(T.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=T.VOCABULARY_B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    with open(T.VOCABULARY_A, encoding="utf-8") as f:
        spelled_a = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if t != "<|endoftext|>"}
    spelled_b = {}
    for i in range(b.get_piece_size()):
        p = b.id_to_piece(i)
        spelled_b[i] = bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        same = b"".join(spelled_a[i] for i in one) == whole == b"".join(spelled_b[i] for i in two)
        return (one, two) if same else ([], [])

    return encode, spelled_a, spelled_b


def _walk(text, plain):
    """Ids, links and groups of one text."""
    encode, spelled_a, spelled_b = plain
    one, two = encode(text)
    places = []
    for ids, spelled in ((one, spelled_a), (two, spelled_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spelled[i]), i))
            at = out[-1][1]
        places.append(out)
    cuts = sorted({x[1] for x in places[0]} & {x[1] for x in places[1]})
    links, groups, rest = [], [], [list(reversed(p)) for p in places]
    for cut in cuts:  # within a group every pair is compared
        a, b = [], []
        for side, into in zip(rest, (a, b)):
            while side and side[-1][1] <= cut:
                into.append(side.pop())
        links += [(i, j) for s, e, i in a for s2, e2, j in b if s < e2 and s2 < e]
        groups.append(([x[2] for x in a], [x[2] for x in b]))
    return one, two, links, groups


def _brute(rows, plain):
    walked = [(i, *_walk(t, plain)) for i, t in rows]
    counts = Counter(x for w in walked for x in w[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, a, b, links, groups in walked:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return Counter(out), counts


ODD = [
    (1, None, None), (2, "", "a"), (3, " ", "a"), (4, "  two  spaces ", "a"), (5, "▁ mark", "a"), (6, "<|endoftext|> <s> </s> <unk> <0x41>", "a"), (7, "naïve “quotes” – 漢字 🙂 é", "b"), (8, "tabs\tand\r\nlines\n\n", "b"),
    (9, "same text here", "b"), (9, "same text here", "b"), (None, "same text here", "b"), (10, "x" * 900, "c"), (11, "don't 12345 A1b2", "c"), (12, "a" + " " * 30 + "b", "c"), (13, "\x00\x01\x7f", "c"), (14, "﻿bom ​ zero", "c"),
]


def test_against_a_plain_walk(spark, edge, edge_rows, empty, plain, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 500)  # several shards, with keys at their edges
    for frame, rows in ((docs(spark, ODD), ODD), (edge, edge_rows)):
        made = T.Alignment(spark, frame)
        want, counts = _brute([(i, t) for i, t, _ in rows], plain)
        assert Counter(map(tuple, made.documents().collect())) == want
        assert {(r.a_id, r.b_id): r.n for r in made.counts().collect()} == counts
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        assert {r.b_id: r.n for r in made.best().collect()} == best
    assert T.Alignment(spark, empty).documents().count() == 0 == T.Alignment(spark, empty).counts().count()


def test_chunks_are_encoded_as_in_the_whole_text(plain):
    """Letters and signs of both alphabets and of others, odd spaces, contractions, numbers."""
    rng = random.Random(1)
    settled, odd = [chr(c) for c in range(1, 0x250)], list("  \n\t\r\x85\xa0 　 ᠎​﻿‐“”’漢かا😀é \x1c'")
    encoder = T.Encoder(T.VOCABULARY_A, T.VOCABULARY_B)
    for _ in range(1500):
        pool = rng.choice([settled, odd, [*settled[:127], *odd, *[" "] * 20, "'s", " 12", "<s>", "▁"]])
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
        ((a, b),) = encoder.ids([text.encode()])
        assert (np.frombuffer(a, np.int32).tolist(), np.frombuffer(b, np.int32).tolist()) == plain[0](text), repr(text)
    assert encoder.ids([b"\xff broken", b""]) == [(b"", b""), (b"", b"")]


def test_long_runs_of_white_space_and_long_texts(spark):
    rows = [(1, "a" + " " * 200_000 + "b", "a"), (2, "word " * 100_000, "a")]
    got = {r.id: r for r in T.Alignment(spark, docs(spark, rows)).documents().collect()}
    assert got[1].n_a > 0 and got[2].n_groups >= 100_000 and got[2].n_links == got[2].n_best


def test_groups_of_a_text(plain):
    for text in ("A tokenisation's alignment, über 1234 naïve words", "x", " lead"):
        assert T.groups(text) == _walk(text, plain)[3]


def test_shards_of_a_store_that_cannot_be_mapped(tmp_path):
    """Whole shards are read, few at a time; a key is found whichever shard holds it."""
    shards = T.Shards(str(tmp_path))
    keys = np.arange(0, 60, 2)
    names = [shards.write(keys[lo : lo + 5], keys[lo : lo + 5] * 7) for lo in range(0, 30, 5)]
    remote = T.Shards(f"file://{tmp_path}")
    remote.local = None
    for store in (shards, remote):
        assert store.find(np.array([0, 8, 10, 58]), keys[::5], names).tolist() == [0, 56, 70, 406]
    assert len(remote.held) <= T.HELD
