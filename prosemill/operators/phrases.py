"""Detection and removal of phrases that many entities share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import text as X
from ..sources import shared
from .keyfilter import KeyFilter

#: Unicode white space
WHITE = r"[\x09-\x0D\x20\x{85}\p{Z}]+"
TRIM = ",;:. "  # cut around a removed phrase


_U64 = np.uint64
#: bits of a hash by which phrases are counted; bytes of text that are worked on at once
_KEY, SLICE = _U64((1 << 44) - 1), 4 << 20
#: names that are told apart while hashes are counted; of more names, a hash counts as often as it stands in slices
MOST_NAMES = 1 << 16
#: (phrase, name) that a task remembers to have given out
GIVEN = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(32))) * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def _runs(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For each n: the hashes of all runs of n words, their rows and first words, and all words. Words stand
    between runs of Unicode white space."""
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(texts, ""), WHITE, " "), " ")
    split = pc.split_pattern(plain, " ")
    cuts = split.offsets.to_numpy().astype(np.int64)
    said = split.flatten()
    coded = said.dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()]
    h = np.array(known, _U64)[coded.indices.to_numpy()] if len(known) else np.zeros(0, _U64)
    row = np.repeat(np.arange(len(texts)), np.diff(cuts))
    if pc.any(pc.equal(plain, "")).as_py():  # splits into one empty word
        solid = np.flatnonzero(~pc.equal(said, "").to_numpy(zero_copy_only=False))
        h, row, said = h[solid], row[solid], said.take(pa.array(solid))
    for n in sizes:
        count = max(0, len(h) - n + 1)
        at = np.flatnonzero(row[:count] == row[n - 1 :]) if count else np.zeros(0, np.int64)
        runs = np.full(len(at), _U64(n))
        for d in range(n):
            runs = _mix(runs * _U64(0x9E3779B97F4A7C15) + h[at + d])
        yield n, runs, row[at], at, said


def _hopeful(texts: pa.Array, n: int, parts: tuple[int, KeyFilter] | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the runs of n words all of whose parts, runs of fewer words, a filter lets through."""
    if parts is None:
        return next((h, row) for _, h, row, _, _ in _runs(texts, (n,)))
    m, held = parts
    (_, h, _, at, said), (_, runs, row, begin, _) = _runs(texts, (m, n))
    passes = np.zeros(len(said) + 1, bool)
    passes[at[held.has(h & _KEY)]] = True
    some = np.ones(len(begin), bool)
    for d in range(n - m + 1):
        some &= passes[begin + d]
    return runs[some], row[some]


def _first_of_each(h: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Places of one of each different pair."""
    if not len(h):
        return np.zeros(0, np.int64)
    _, code = np.unique(h, return_inverse=True)
    return np.unique(code * (int(who.max()) + 1) + who, return_index=True)[1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written in the shared folder and read back, for tables that are read more than once."""
    path = shared.new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to as many tasks as there are cores where the scan has fewer; otherwise as they are.
    Not for tables that are computed: asking for their partitions runs their shuffles."""
    few = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(few) if df.rdd.getNumPartitions() < few else df


def _rows(df: DataFrame, name: str, text: str) -> DataFrame:
    """name (lowered) and text."""
    return df.select(F.lower(name).alias("name"), F.col(text).cast("string").alias("text"))


def frequent_names(df: DataFrame, name: str, text: str, sizes: Sequence[int], least: int, least_bytes: int = 10) -> DataFrame:
    """Distinct (n, phrase, name) of all phrases with at least `least` names and `least_bytes` bytes, and perhaps of
    some with fewer names, which `frequent` and `dissimilar` count and drop.

    A first pass over the text counts per 44-bit hash of a phrase the names it stands under, or, where there are over `MOST_NAMES`
    names, how often it stands in a slice of the text under a name, which is as often as it has names or more; hashes are shuffled
    packed, four bytes each and one or two for the name. Sizes are counted one after another: a phrase stands under no name that a
    part of it lacks, so of a size only the phrases are counted whose parts of the size before reached the number. A last pass writes out only the
    phrases whose hash reached the number. Where these are more than a filter of bounded size tells apart, there is a
    last pass for each part of them. A null name is a name; null and empty texts have no phrases.
    """
    spark = df.sparkSession
    rows = _rows(df, name, text)
    numbers = _numbers(rows) if least > 1 else None

    def hashed(n: int, parts: tuple[int, KeyFilter] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches):
                names, who = _who(batch)
                h, row = _hopeful(batch.column(1), n, parts)
                some = _first_of_each(h, who[row])
                some = some[np.argsort(h[some] & _KEY)]
                keys = h[some] & _KEY
                bucket = (keys >> _U64(32)).astype(np.int32)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = np.append(first, len(keys))
                packed = [_packed(keys.astype(np.uint32), cuts)]
                if numbers is not None:
                    kind = np.uint8 if len(numbers) <= 256 else np.uint16
                    of = np.array([numbers[x] for x in names.dictionary.to_pylist()], kind)
                    packed.append(_packed(of[who[row[some]]], cuts))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packed], names=["bucket", "keys", "names"][: 1 + len(packed)])

        return run

    reached, parts = [], None
    for n in sorted(set(sizes)):
        packed = rows.mapInArrow(hashed(n, parts), "bucket int, keys binary" + (", names binary" if numbers is not None else "")).repartition("bucket").sortWithinPartitions("bucket")
        reached.append(stored(packed.mapInArrow(_reached(least), "key long"), "hashes"))
        parts = (n, KeyFilter(spark, reached[-1])) if least > 1 else None
    filters = KeyFilter.shared(spark, reduce(DataFrame.unionByName, reached))
    schema = "n int, phrase string, name string"
    passes = [rows.mapInArrow(_spelled(held, sizes), schema) for held in filters]
    # all rows of a phrase meet at once, for those who count its names
    return reduce(DataFrame.unionByName, passes).filter(F.octet_length("phrase") >= least_bytes).repartition("n", "phrase").distinct()


def _sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows (name, text) in slices of a bounded number of bytes of text, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _who(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The names of a slice and each row's place among them."""
    names = batch.column(0).dictionary_encode(null_encoding="encode")
    return names, names.indices.to_numpy().astype(np.int64)


def _numbers(rows: DataFrame) -> dict[str | None, int] | None:
    """A number for each name, null included; None if there are over `MOST_NAMES`."""
    held = rows.select("name").distinct().limit(MOST_NAMES + 1).collect()
    return {r.name: k for k, r in enumerate(held)} if len(held) <= MOST_NAMES else None


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _reached(least: int):
    """Keys that stand `least` times or more, or under as many different names, in rows (bucket, keys, perhaps the keys' names),
    those of a bucket together."""

    def often(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
        low = np.concatenate(held)
        low = (np.unique(low) >> _U64(16)).astype(np.uint32) if low.dtype == np.uint64 else np.sort(low)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
        some = low[first[np.diff(np.append(first, len(low))) >= least]]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64) | (bucket << 32))], names=["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            of = batch.column(2) if batch.num_columns > 2 else [None] * len(batch)
            for bucket, keys, names in zip(batch.column(0).to_pylist(), batch.column(1), of, strict=True):
                if bucket != last and held:
                    yield often(last, held)
                    held = []
                last = bucket
                low = np.frombuffer(keys.as_buffer(), np.uint32)
                if names is None:
                    held.append(low.copy())
                else:
                    who = names.as_buffer()
                    held.append((low.astype(np.uint64) << _U64(16)) | np.frombuffer(who, np.uint8 if who.size == len(low) else np.uint16))
        if held:
            yield often(last, held)

    return run


def _spelled(held: KeyFilter, sizes: Sequence[int]):
    """(n, phrase, name) of rows (name, text), of the phrases that the filter lets through. A task leaves out most of what it has
    given out, by a table of the last hash at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(GIVEN, _U64)
        for batch in _sliced(batches):
            names, who = _who(batch)
            named = np.array([int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()], _U64)
            for n, h, row, at, said in _runs(batch.column(1), sizes):
                some = np.flatnonzero(held.has(h & _KEY))
                some = some[_first_of_each(h[some], who[row[some]])]
                code = _mix(h[some] ^ named[who[row[some]]] + _U64(n)) | _U64(1)
                place = (code >> _U64(1)) % _U64(GIVEN)
                fresh = given[place] != code
                given[place[fresh]] = code[fresh]
                some = some[fresh]
                words = [said.take(pa.array(at[some] + d)) for d in range(n)]
                phrase = pc.binary_join_element_wise(*words, " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), phrase, names.dictionary.take(pa.array(who[row[some]]))], names=["n", "phrase", "name"])

    return run


def phrase_names(df: DataFrame, name: str, text: str, sizes: Sequence[int], least_bytes: int = 10) -> DataFrame:
    """Distinct (n, phrase, name) of all phrases."""
    return frequent_names(df, name, text, sizes, 1, least_bytes)


def frequent(names: DataFrame, least: int) -> DataFrame:
    """n, phrase, total: phrases with at least `least` names."""
    return names.groupBy("n", "phrase").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= least)


def _containing(names: DataFrame) -> DataFrame:
    """(earlier, name): pairs of different names, the smaller first, of which one contains the other, both with
    first words of 4 bytes or more. They meet by the first four characters of the shorter one (all, if fewer)."""
    first = lambda c: F.coalesce(F.get(X.words(F.col(c)), F.lit(0)), F.lit(""))
    some = names.select("name").distinct().filter(F.octet_length(first("name")) >= 4)
    short = some.select(F.col("name").alias("part"), F.substring("name", 1, 4).alias("gram"))
    sizes = ", ".join(f"transform(sequence(1, length(name)), i -> substring(name, i, {k}))" for k in range(1, 5))
    long = some.select("name", F.explode(F.expr(f"array_distinct(concat({sizes}))")).alias("gram"))
    pairs = short.join(long, "gram").filter((F.col("part") != F.col("name")) & F.contains("name", "part"))
    return pairs.select(F.least("part", "name").alias("earlier"), F.greatest("part", "name").alias("name")).distinct()


def dissimilar(names: DataFrame, least: int) -> DataFrame:
    """n, phrase, total, distinct_names: names count unless an earlier one is similar to them.

    Of the names of a phrase with the same first word only the smallest is not similar to an earlier one, which
    is an aggregate; names that contain one another are found once for all phrases, among the distinct names, and
    only those pairs meet the phrases. So a phrase that many names share makes no pairs of its names.
    """
    # from here on a number stands for the phrase, that of its first row, so that joins do not shuffle phrases
    phrase = Window.partitionBy("n", "phrase")
    names = names.withColumn("id", F.monotonically_increasing_id()).withColumns({"total": F.count(F.lit(1)).over(phrase), "of": F.min("id").over(phrase)})
    names = stored(names.filter(F.col("total") >= least), "names")
    kept = names.filter(F.col("name").isNotNull())
    first = F.coalesce(F.get(X.words(F.col("name")), F.lit(0)), F.lit(""))
    # names without a first word are each similar to no earlier one
    by = kept.withColumn("first", F.when(first != "", F.concat(F.lit("w"), first)).otherwise(F.concat(F.lit("n"), "name")))
    lead = by.groupBy("of", "first").agg(F.min("name").alias("name"))
    pairs = _containing(kept)
    after = lead.join(pairs, "name").select("of", "name", "earlier")
    after = after.join(kept.select("of", F.col("name").alias("earlier")), ["of", "earlier"]).select("of", "name").distinct()
    alone = lead.join(after, ["of", "name"], "left_anti")
    counted = alone.select("of").unionByName(names.filter(F.col("name").isNull()).select("of"))
    counted = counted.groupBy("of").agg(F.count(F.lit(1)).alias("distinct_names")).filter(F.col("distinct_names") >= least)
    return names.filter(F.col("id") == F.col("of")).join(counted, "of").select("n", "phrase", "total", "distinct_names")


def top_phrases(ranked: DataFrame, most: int) -> DataFrame:
    """The first `most` per n, with their rank; ties by phrase."""
    w = Window.partitionBy("n").orderBy(F.desc("distinct_names"), F.desc("total"), "phrase")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def drop_overlaps(top: DataFrame) -> DataFrame:
    """pos, phrase in order of n and rank, without phrases that contain or are in an earlier one.

    `top` is a top-k report, a few dozen rows, folded in one array.
    """
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "rank", "phrase"))), lambda x: x["phrase"]).alias("all"))
    fold = F.aggregate("all", F.array().cast("array<string>"), lambda acc, p: F.when(F.exists(acc, lambda q: F.contains(p, q) | F.contains(q, p)), acc).otherwise(F.array_append(acc, p)))
    return listed.select(F.posexplode(fold).alias("pos", "phrase"))


def lowered(text: str) -> str:
    """Lower case, one character for each; a letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


class Remover:
    """Each phrase in order removed until it is absent, the cut ends joined by a space.

    One automaton finds which phrases a text holds; a cut can only bring out others across its joint, so after it
    the automaton reads the joint's surroundings. Every cut shortens the text or is the last of its phrase.
    """

    def __init__(self, phrases: Sequence[str]):
        import ahocorasick

        self.phrases = [lowered(p) for p in phrases]
        self.reach = max(map(len, self.phrases), default=0)
        self.automaton = ahocorasick.Automaton()
        for place, phrase in enumerate(self.phrases):
            if phrase:
                self.automaton.add_word(phrase, (*self.automaton.get(phrase, ()), place))
        if self.reach:
            self.automaton.make_automaton()

    def _held(self, low: str) -> set[int]:
        return {place for _, places in self.automaton.iter(low) for place in places}

    def __call__(self, text: str) -> str:
        low = lowered(text)
        waiting = self._held(low) if self.reach else set()
        while waiting:
            place = min(waiting)
            waiting.discard(place)
            phrase, at = self.phrases[place], 0
            while (at := low.find(phrase, max(0, at - self.reach))) >= 0:
                left, right = low[:at].rstrip(TRIM), low[at + len(phrase) :].lstrip(TRIM)
                start = len(low) - len(right)
                gap = " " if left and right else ""
                text, low = text[: len(left)] + gap + text[start:], left + gap + right
                at = len(left)
                joint = low[max(0, at - self.reach) : at + self.reach + 1]
                waiting |= {later for later in self._held(joint) if later > place}
        return re.sub(r"\s+", " ", text).strip(TRIM)


_removers: dict[tuple[str, ...], Remover] = {}


def remove_once(text: str, phrases: Sequence[str]) -> str:
    """`text` without the phrases, by the automaton of this list, which is kept."""
    listed = tuple(phrases)
    if listed not in _removers:
        _removers[listed] = Remover(listed)
    return _removers[listed](text)


def remove_phrases(c: Column, phrases: Sequence[str] = C.PHRASES) -> Column:
    """Ordered removal to a fixpoint: an Arrow function, since each removal may expose the next.

    Rows without any phrase skip it and get the final trimming by built-in functions. A worker holds a few MB of texts
    at a time, or one longer text: the session's Arrow batches are bounded by bytes.
    """
    listed = tuple(phrases)
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE))

    @F.arrow_udf(T.StringType())
    def removed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else remove_once(t, listed) for t in texts.to_pylist()], pa.string())

    plain = F.btrim(F.regexp_replace(c, X.SPACES, " "), F.lit(TRIM))
    return F.when(X.any_of(c, listed), removed(F.when(X.any_of(c, listed), c))).otherwise(plain)


def removal_counts(df: DataFrame, before: str, after: str) -> DataFrame:
    """processed, changed (fewer bytes), emptied, in one row."""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.octet_length(after) < F.octet_length(before)).alias("changed"), F.count_if((F.col(before) != "") & (F.col(after) == "")).alias("emptied"))
