"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hash of `K` consecutive words in each sliding window of
`WINDOW` - `K` + 1 such hashes. Equal spans of `WINDOW` words choose the same fingerprint at the same
place, so every shared span of that length shares a fingerprint. Training and test fingerprints are
joined, and each hit is extended word by word to the left and right; words decide, hashes do not.
Items of fewer words are one window, found by the hash of all their words.

Documents emit only fingerprints that a filter of bounded size may hold, so the join is as large as the
overlap, not as the corpus. It carries no item lists: windows carry the number of their set of items, and sets are
joined once a document and set. Spark broadcasts the fingerprints of the benchmark below its own threshold; above it
the join is a sort-merge join, whose partitions AQE splits where many documents share a passage.

Defined results: null and empty texts have no words and no hits; repeated rows have a result each;
repeated items count once each by their identifier, and those without one as one item that has no name in
the list; an empty table gives an empty result, an empty
benchmark no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import blocks, gram_hashes, prefix, sliding_argmin, span_hash, spread, word_hashes, words
from .common import KEY, KeyFilter, Scratch, table, with_key

WINDOW, K, CONTAMINATED = 8, 4, 2
#: consecutive words of one item that make a leak by themselves
LONG = 13

#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lowered
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_HIT = "struct<pos:int,fp:bigint,size:int,left:int,around:array<string>>"


def _fingerprints(h: np.ndarray, cuts: np.ndarray, short: tuple[int, ...]):
    """(word position, hash, words hashed, window size) of the fingerprints of all documents of a block."""
    out = []
    n = np.diff(cuts)
    pre = prefix(h)
    if len(h) >= WINDOW:
        grams = gram_hashes(h, K)
        chosen = sliding_argmin(grams, WINDOW - K + 1)[spread(cuts[:-1], np.maximum(n - WINDOW + 1, 0))]
        chosen = np.unique(chosen)
        out.append((chosen, grams[chosen], K, WINDOW))
    for size in short:
        at = spread(cuts[:-1], np.maximum(n - size + 1, 0))
        out.append((at, span_hash(pre, at, at + size), size, size))
    return out


def _hits(texts: pa.Array, short: tuple[int, ...], held: KeyFilter | None):
    """Per row: number of words and the fingerprints that `held` may contain (all, if None)."""
    counts, found = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
    for lo, hi, data, offsets in blocks(texts):
        data = _LOWER[data]
        starts, ends, cuts = words(data, offsets, _GAP)
        counts[lo:hi] = np.diff(cuts)
        raw = data.tobytes()
        for at, fps, size, window in _fingerprints(word_hashes(data, starts, ends), cuts, short):
            if held is not None:
                some = np.flatnonzero(held.has(fps))
                at, fps = at[some], fps[some]
            row = np.searchsorted(cuts, at, "right") - 1
            for p, fp, r in zip(at.tolist(), fps.view(np.int64).tolist(), row.tolist(), strict=True):
                room = WINDOW - K if window == WINDOW else 0
                a, b = max(int(cuts[r]), p - room), min(int(cuts[r + 1]), p + size + room)
                found[lo + r].append({"pos": p - int(cuts[r]), "fp": fp, "size": window, "left": p - a, "around": [raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]})
    return counts, found


def _table_of(batch: pa.RecordBatch, counts: np.ndarray, found: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("fp", pa.int64()), ("size", pa.int32()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(found, kind)], names=["id", "n_words", "hits"])


def benchmark_fingerprints(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp, size, left, around, items: fingerprints with the words around them and whose they are (id, n_words)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = _hits(batch.column(1), (), None)
            for lo, hi, data, offsets in blocks(batch.column(1)):
                data = _LOWER[data]
                starts, ends, cuts = words(data, offsets, _GAP)
                h, raw = word_hashes(data, starts, ends), data.tobytes()
                pre = prefix(h)
                for r in range(hi - lo):
                    a, b = int(cuts[r]), int(cuts[r + 1])
                    if 0 < b - a < WINDOW:
                        fp = span_hash(pre, np.array([a]), np.array([b])).view(np.int64)[0]
                        found[lo + r].append({"pos": 0, "fp": int(fp), "size": b - a, "left": 0, "around": [raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]})
            yield _table_of(batch, counts, found)

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    flat = rows.mapInArrow(emit, f"id string, n_words long, hits array<{_HIT}>").select("id", "n_words", F.explode("hits").alias("h")).select("id", "n_words", "h.*")
    return flat.groupBy("fp", "size", "left", "around").agg(F.sort_array(F.collect_set(F.struct("id", "n_words"))).alias("items"))


def _matched(doc_at: str, item_at: str, steps: int) -> str:
    """SQL: how many of the next `steps` words are the same, word for word."""
    return f"aggregate(transform(sequence(0, {steps - 1}), j -> coalesce(get(d_around, {doc_at}) = get(i_around, {item_at}), false)), named_struct('on', true, 'n', 0), (a, e) -> named_struct('on', a.on and e, 'n', a.n + cast(a.on and e as int)), a -> a.n)"


def shared_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of `docs` (rid, id, n_words); the spans (rid, a, b, set) of words they share with items; the
    sets (set, items) of items, structs of id and n_words."""
    scratch = Scratch(spark)
    found = scratch.write(benchmark_fingerprints(benchmark, item_col, item_text), "found")
    sets = scratch.write(found.select("items").distinct().select(F.monotonically_increasing_id().alias("set"), "items"), "sets")
    tests = scratch.write(found.join(sets, "items").select("fp", "size", F.col("left").alias("i_left"), F.col("around").alias("i_around"), "set"), "tests")
    short = tuple(sorted(r[0] for r in tests.filter(F.col("size") < WINDOW).select("size").distinct().collect()))  # at most WINDOW - 1
    held = KeyFilter(spark, tests.select(F.col("fp").alias("key")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table_of(batch, *_hits(batch.column(1), short, held))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, hits array<{_HIT}>"
    seen = scratch.write(rows.mapInArrow(emit, schema).withColumn("rid", F.monotonically_increasing_id()), "seen")
    pairs = seen.select("rid", F.explode("hits").alias("h")).select("rid", "h.pos", "h.fp", "h.size", F.col("h.left").alias("d_left"), F.col("h.around").alias("d_around"))
    pairs = pairs.join(tests, ["fp", "size"])
    core = F.when(F.col("size") < WINDOW, F.col("size")).otherwise(K)
    pairs = pairs.withColumn("core", core).withColumn("before", F.expr(_matched("d_left - 1 - j", "i_left - 1 - j", WINDOW - K))).withColumn("from_core", F.expr(_matched("d_left + j", "i_left + j", WINDOW)))
    whole = (F.col("from_core") >= F.col("core")) & (F.col("before") + F.col("from_core") >= F.col("size"))
    spans = pairs.filter(whole).select("rid", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("from_core") - 1).alias("b"), "set")
    return seen.select("rid", "id", "n_words"), scratch.write(spans, "spans"), sets


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items (sorted array)."""
    seen, spans, sets = shared_spans(spark, docs, benchmark, id_col, text_col, item_col, item_text)
    hit = spans.groupBy("rid").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "b"))))).cast("long").alias("n_hit"))
    items = F.transform(F.flatten(F.collect_list("items")), lambda x: x["id"])
    whose = spans.select("rid", "set").distinct().join(sets, "set").groupBy("rid").agg(F.array_sort(F.array_distinct(items)).alias("items"))
    return seen.join(hit.join(whose, "rid"), "rid", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: SQL: the most consecutive numbers in the sorted array `at`
_RUN = "aggregate(at, named_struct('last', -2, 'run', 0, 'most', 0), (s, p) -> named_struct('last', p, 'run', if(p = s.last + 1, s.run + 1, 1), 'most', greatest(s.most, if(p = s.last + 1, s.run + 1, 1))), s -> s.most)"


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id of the rows of `docs` with windows of `CONTAMINATED` items, with half their words or more inside windows,
    or with a run of words inside windows of one item that has `LONG` words, or `WINDOW` words and half of the item."""
    seen, spans, sets = shared_spans(spark, docs, benchmark, id_col)
    per_item = spans.join(sets, "set").select("rid", F.sequence("a", "b").alias("at"), F.explode("items").alias("item"))
    per_item = per_item.groupBy("rid", F.col("item.id").alias("item")).agg(F.min("item.n_words").alias("item_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"))
    run = F.expr(_RUN)
    long = (run >= LONG) | ((run >= WINDOW) & (2 * run >= F.col("item_words")))
    per_doc = per_item.select("rid", "at", long.alias("long")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), F.max("long").alias("long"), F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n_hit"))
    return seen.join(per_doc, "rid").filter((F.col("n_items") >= CONTAMINATED) | F.col("long") | (2 * F.col("n_hit") >= F.col("n_words"))).select("id")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are no `leaks`, with their columns; each row is judged by its own text, also
    where identifiers are null or repeated."""
    keyed, _ = with_key(docs, "doc_id", "text")
    out = leaks(spark, keyed, benchmark, KEY)
    return keyed.join(out.select(F.col("id").alias(KEY)), KEY, "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= CONTAMINATED).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.s = win.s AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
