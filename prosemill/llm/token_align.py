"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often.

Every text is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B). Both spell the same bytes, a
space and the text, so the byte offsets where tokens end align them: an A token and a B token are linked where their
bytes overlap, and offsets at which both end cut the tokens into groups.

A link is one packed int64, the B id in the upper and the A id in the lower 32 bits. Texts are aligned in blocks of a
bounded number of bytes; a block's links are counted by `np.unique` and the documents keep only places in its list.
Blocks are merged to partial counts per task, partial counts are sorted over the cluster by ranges of keys, and
equal neighbours summed up. The sums are written as shards of at most `SHARD` keys in the shared folder. A document's
links are then looked up by binary search in the shards, which tasks map into memory, so a task holds what it touches
of them; shuffled are only partial counts. There are at most |A| x |B| different keys, whatever the corpus.

Defined results: null and empty texts have no tokens, nor have texts that A or B do not spell as they are, such as those
with U+2581 or with broken UTF-8: their numbers are 0 and their digest is ''. Repeated rows count as often as they
stand; identifiers may be null or repeated; ties for a B token's most frequent link all count as best; an empty
table gives an empty result; a very long text is a block of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import blocks
from .common import ROW_GROUPS, Scratch, table
from .token_counts import LONG_WHITE, PATTERN, WHITE_SPACE

VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of text in a block: a worker takes some 150 bytes for each while it aligns them
BLOCK = 1 << 18
#: keys of one shard (16 MB), and keys that a task merges at once
SHARD, MERGE = 1 << 20, 1 << 20
#: shards that a task keeps in memory where the shared folder cannot be mapped
HELD = 4
#: Characters whose letter, number and space classes no Unicode version has moved; other chunks take the slower encoder.
_SETTLED = re.compile("[^\x00-\u024f\u2010-\u2027]")
_LONG_SPACE = re.compile(f"{WHITE_SPACE}{{{LONG_WHITE},}}")
#: No token of A or B holds a space after a character that is no white space, so texts are encoded in chunks cut there.
_CHUNK = re.compile("(?<=[^\\s\u180e\u200b\u2060\ufeff])(?= )")
#: chunks up to this length are remembered, this many at most
CHUNK_LENGTH, CHUNKS = 64, 100_000
_loaded: dict = {}


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 as it is, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """The A vocabulary: encoder, and the bytes of its tokens."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        letters = _byte_of_letter()
        special = {x["id"] for x in vocabulary["added_tokens"]}
        self.spelled = {i: bytes(letters[c] for c in token) for token, i in vocabulary["model"]["vocab"].items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.spelled.items()}, special_tokens={})

    def encode(self, chunk: str) -> list[int]:
        """Ids of a chunk, which begins with a space."""
        if not _SETTLED.search(chunk) and (len(chunk) < LONG_WHITE or not _LONG_SPACE.search(chunk)):
            return self.fast.encode_ordinary(chunk)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(chunk, add_special_tokens=False).ids


class Pieces:
    """The B vocabulary: encoder, and the bytes of its tokens. The encoder adds the first space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = lambda p, i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.spelled = {i: byte(p, i) for i, p in enumerate(pieces)}
        self.space = self.model.piece_to_id("▁")

    def encode(self, chunk: str) -> list[int]:
        """Ids of a chunk, which begins with a space; a lone space gets no first space from the encoder."""
        return self.model.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.space]


def _vocabulary(kind: type, path: str):
    """A vocabulary with the lengths of its tokens, once per Python worker."""
    if (kind, path) not in _loaded:
        made = kind(path)
        made.sizes = np.zeros(max(made.spelled) + 1, np.int64)
        made.sizes[list(made.spelled)] = [len(b) for b in made.spelled.values()]
        _loaded[kind, path] = made
    return _loaded[kind, path]


def _listed(n: int) -> pa.Array:
    """Entry 3 i + s: the decimal number i and the s-th separator."""
    if ("listed", n) not in _loaded:
        _loaded["listed", n] = pa.array([b"%d%c" % (i, s) for i in range(n) for s in b",|;"], pa.large_binary())
    return _loaded["listed", n]


class Encoder:
    """Both vocabularies. The different chunks of a block are encoded together, as one text, and remembered."""

    def __init__(self, a: str, b: str):
        self.a, self.b, self.known = _vocabulary(ByteLevel, a), _vocabulary(Pieces, b), {}

    def _encode(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """32-bit ids of A and of B for chunks that may follow one another; None where they do not spell a chunk."""
        said = "".join(chunks)
        raw, sides = said.encode(), []
        size = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        for side in (self.a, self.b):
            ids = side.encode(said)
            if b"".join(map(side.spelled.__getitem__, ids)) != raw:
                return {chunks[0]: None} if len(chunks) == 1 else {k: v for c in chunks for k, v in self._encode([c]).items()}
            ids = np.array(ids, np.int32)
            cuts = np.searchsorted(np.cumsum(side.sizes[ids]), np.cumsum(size), "right") * 4
            packed = ids.tobytes()
            sides.append([packed[i:j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)])
        return dict(zip(chunks, zip(*sides, strict=True), strict=True))

    def ids(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """32-bit ids of A and of B per text; none where they do not spell a space and the text."""
        split = []
        for raw in texts:
            try:
                split.append(_CHUNK.split(" " + raw.decode()) if raw else [])
            except UnicodeDecodeError:
                split.append([])
        if len(self.known) > CHUNKS:
            self.known.clear()
        new = {c for chunks in split for c in chunks if c not in self.known}
        apart = [c for c in new if len(c) > CHUNK_LENGTH or c[-1].isspace() or _SETTLED.search(c)]
        new.difference_update(apart)
        self.known.update(self._encode(sorted(new)) if new else {})
        rare = {k: v for c in apart for k, v in self._encode([c]).items()}
        find, out = {**rare, **self.known}.get if rare else self.known.get, []
        for chunks in split:
            ids = [find(c) for c in chunks]
            out.append((b"", b"") if None in ids else (b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])))
        return out


class Block:
    """Aligned tokens of a block of texts: per text `n_a`, `n_b`, `n_groups`, `n_links`, and per link the A and B ids."""

    def __init__(self, texts: list[bytes], encoder: Encoder):
        sizes_a, sizes_b = encoder.a.sizes, encoder.b.sizes
        ids = encoder.ids(texts)
        self.n_a, self.n_b = (np.array([len(x[side]) // 4 for x in ids], np.int64) for side in (0, 1))
        self.a, self.b = (np.frombuffer(b"".join([x[side] for x in ids]), np.int32).astype(np.int64) for side in (0, 1))
        self.end_a, self.end_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        ends = np.sort(np.concatenate([self.end_a, self.end_b]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends  # each stretch between two ends is in one A and one B token
        at_a, at_b = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        self.link_a, self.link_b = self.a[at_a], self.b[at_b]
        both = (self.end_a[at_a] == ends) & (self.end_b[at_b] == ends)
        self.group_ends = ends[both]
        cuts_a = np.cumsum(self.n_a)
        last = np.concatenate(([0], self.end_a))[cuts_a]  # where each text's bytes end
        self.link_cuts = np.concatenate(([0], np.searchsorted(ends, last, "right")))
        self.n_links = np.diff(self.link_cuts)
        self.n_groups = np.diff(np.concatenate(([0], np.searchsorted(self.group_ends, last, "right"))))

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text as `a,a|b;a|b,b`; '' without tokens."""
        in_a, in_b = np.searchsorted(self.group_ends, self.end_a), np.searchsorted(self.group_ends, self.end_b)
        n = len(self.group_ends)
        before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (in_a, in_b))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, group, shift, end in ((self.a, in_a, before_b[in_a], 1), (self.b, in_b, before_a[in_b + 1], 2)):
            closes = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
            code[np.arange(len(ids)) + shift] = 3 * ids + np.where(closes, end, 0)
        said = _listed(1 << 16 if not len(code) else max(1 << 16, int(code.max()) // 3 + 1)).take(pa.array(code))
        cuts = np.frombuffer(said.buffers()[1], np.int64)[said.offset :] if len(said) else np.zeros(1, np.int64)
        raw = memoryview(said.buffers()[2]) if len(said) and said.buffers()[2] is not None else memoryview(b"")
        ends = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        return [hashlib.sha256(raw[cuts[lo] : cuts[hi] - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b << 32 | a


def _run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of a sorted list, and the sums of their counts."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Shards:
    """Sorted count shards in the shared folder: arrays of two rows, keys and counts.

    A folder that all machines mount (a `file` address) is mapped into memory; from another store, which cannot be
    mapped, whole shards are read and `HELD` of them kept.
    """

    def __init__(self, folder: str):
        self.folder, self.held = folder, OrderedDict()
        at = urlsplit(folder)
        self.local = unquote(at.path) if at.scheme in ("", "file") else None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder)

    def write(self, keys: np.ndarray, counts: np.ndarray) -> str:
        """A new file; a task that runs again writes one of its own, and only the listed one is read."""
        name, both = f"{uuid.uuid4().hex}.npy", np.stack([keys, counts])
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            np.save(f"{self.local}/{name}", both)
        else:
            store, path = self._store()
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                np.save(out, both)
        return name

    def open(self, name: str) -> np.ndarray:
        if self.local is not None:
            return np.load(f"{self.local}/{name}", mmap_mode="r")
        if name not in self.held:
            store, path = self._store()
            with store.open_input_stream(f"{path}/{name}") as f:
                self.held[name] = np.load(pa.BufferReader(f.read()))
            if len(self.held) > HELD:
                self.held.popitem(last=False)
        return self.held[name]

    def find(self, keys: np.ndarray, firsts: np.ndarray, names: list[str]) -> np.ndarray:
        """Counts of sorted keys, all of which have one; `firsts` are the first keys of the shards `names`."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, firsts), len(keys))
        for i in np.flatnonzero(np.diff(cuts)):
            lo, hi, shard = cuts[i], cuts[i + 1], self.open(names[i])
            at = np.searchsorted(shard[0], keys[lo:hi])
            out[lo:hi] = shard[1][at]
        return out


class Alignment:
    """Two vocabularies aligned over the texts of `docs`: `documents`, `counts` and `best` are its results."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = VOCABULARY_A, b: str = VOCABULARY_B):
        self.spark, self.scratch = spark, Scratch(spark)
        self.id_type = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        names = "n_a", "n_b", "n_groups", "n_links"

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(a, b)
            for batch in batches:
                for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                    texts = [data[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                    block = Block(texts, encoder)
                    keys, place, counts = np.unique(_pack(block.link_a, block.link_b), return_inverse=True, return_counts=True)
                    row = np.repeat(np.arange(hi - lo), block.n_links)
                    once, times = np.unique(row * max(1, len(keys)) + place, return_counts=True)
                    n_places = np.bincount(once // max(1, len(keys)), minlength=hi - lo)
                    held = [batch.column(0).slice(lo, hi - lo), *(pa.array(getattr(block, n)) for n in names), pa.array(block.digests()), pa.array(n_places), pa.array((once % max(1, len(keys))).astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(keys), pa.array(counts)]
                    whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held]
                    yield pa.RecordBatch.from_arrays(whole, names=schema_names)

        schema_names = ["id", *names, "digest", "n_places", "place", "times", "key", "count"]
        schema = f"id array<{self.id_type}>, {', '.join(f'{n} array<long>' for n in names)}, digest array<string>, n_places array<long>, place array<int>, times array<int>, key array<long>, count array<long>"
        self.blocks = self.scratch.write(rows.mapInArrow(align, schema), "blocks", **ROW_GROUPS)
        self._sort_counts()

    def _sort_counts(self) -> None:
        def merged(held: list) -> pa.RecordBatch:
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = _run_sums(keys[order], counts[order])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "count"])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                keys, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                held.append((keys, counts))
                size += len(keys)
                if size >= MERGE:
                    yield merged(held)
                    held, size = [], 0
            if held:
                yield merged(held)

        folder = self.scratch.path("shards")

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, keys, counts = Shards(folder), np.zeros(0, np.int64), np.zeros(0, np.int64)

            def listed(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
                b, first = np.unique(k >> 32, return_index=True)
                row = [store.write(k, c), int(k[0]), len(k), b.tolist(), np.maximum.reduceat(c, first).tolist()]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["file", "first", "n", "b", "top"])

            for batch in batches:
                k, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                keys, counts = _run_sums(np.concatenate([keys, k]), np.concatenate([counts, c]))
                while len(keys) > SHARD:  # the last key may go on in the next batch
                    yield listed(keys[:SHARD], counts[:SHARD])
                    keys, counts = keys[SHARD:], counts[SHARD:]
            if len(keys):
                yield listed(keys, counts)

        counted = self.scratch.write(self.blocks.select("key", "count").mapInArrow(partial, "key long, count long"), "partial")
        ordered = counted.repartitionByRange("key").sortWithinPartitions("key")
        self.manifest = self.scratch.write(ordered.mapInArrow(shards, "file string, first long, n long, b array<long>, top array<long>"), "manifest")
        self.scratch.drop("partial")

    def counts(self) -> DataFrame:
        """a_id, b_id, n: how many links of the corpus hold the two."""
        folder = self.scratch.path("shards")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = Shards(folder)
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    keys, counts = store.open(name)
                    yield pa.RecordBatch.from_arrays([pa.array(keys & 0xFFFFFFFF), pa.array(keys >> 32), pa.array(counts)], names=["a_id", "b_id", "n"])

        return self.manifest.select("file").mapInArrow(read, "a_id long, b_id long, n long")

    def best(self) -> DataFrame:
        """b_id, n: the count of the most frequent links of each B id, one row per B id that occurs."""
        return self.manifest.select(F.explode(F.arrays_zip("b", "top")).alias("x")).groupBy(F.col("x.b").alias("b_id")).agg(F.max("x.top").alias("n"))

    def documents(self) -> DataFrame:
        """Per row of the texts: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        shards = self.manifest.select("first", "file").orderBy("first").collect()  # at most |A| |B| / SHARD, and one per partition
        best = self.best().collect()  # at most |B| rows
        top = np.zeros(max([r.b_id for r in best], default=0) + 1, np.int64)
        for r in best:
            top[r.b_id] = r.n
        known = self.spark.sparkContext.broadcast((np.array([r.first for r in shards], np.int64), [r.file for r in shards], top))
        folder = self.scratch.path("shards")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, names, top = known.value
            store = Shards(folder)
            for batch in batches:
                for row in range(len(batch)):
                    held = [c.slice(row, 1).flatten() for c in batch.columns]
                    n_places, place, times, keys = (x.to_numpy(zero_copy_only=False) for x in held[6:])
                    count = store.find(keys, firsts, names)
                    is_best = count == top[keys >> 32]
                    ends = np.cumsum(n_places)
                    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
                    sums = [total(times * is_best[place]), total(times * count[place])]
                    yield pa.RecordBatch.from_arrays([*held[:5], *(pa.array(s, pa.int64()) for s in sums), held[5]], names=names_out)

        names_out = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        read = self.blocks.select("id", "n_a", "n_b", "n_groups", "n_links", "digest", "n_places", "place", "times", "key")
        return read.mapInArrow(look, f"id {self.id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(text: str, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: A ids and B ids of each."""
    block = Block([text.encode()], Encoder(a, b))
    in_a, in_b = np.searchsorted(block.group_ends, block.end_a), np.searchsorted(block.group_ends, block.end_b)
    return [(block.a[in_a == g].tolist(), block.b[in_b == g].tolist()) for g in range(len(block.group_ends))]


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Alignment(spark, docs).documents().withColumnRenamed("id", "doc_id")
