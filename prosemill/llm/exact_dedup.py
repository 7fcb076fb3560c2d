"""Exact dedup by a log-structured merge index, in DataFrame operations only.

* Write-ahead log: one row per document with the SHA-256 digest of its normalised text.
* Memtables flush sorted digest runs: every log partition feeds one of `memtables` memtables, which
  keep one row per digest (smallest identifier, number of rows) and are flushed as a digest-sorted
  Parquet run; each run has a filter of its digests, in a size that does not depend on the data.
* Compaction merges all runs, earlier compactions among them, into one, keeping the smallest identifier of each digest.
* Look-ups probe the filters first and read a run only for the digests that its filter lets through.
* Hits receive byte verification: a fixed-size bit filter of the digests that occur twice picks the
  texts to compare; per digest the smallest and the largest text must be the same bytes. Map-side
  aggregation sends one text per digest and task, so a digest that holds a third of all rows stays
  cheap. Digests that fail (a SHA-256 collision) are regrouped by their texts.

Defined results: null text counts as empty and all empty texts are one group; a null identifier
comes after all others; of repeated rows with the same smallest identifier one row stays; an empty
table gives an empty result; other columns are not read, and `keep_first` returns them as they are. A row
whose digest collides with that of another text is grouped by its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, BitFilter, Scratch, heavy_left_join, table


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _entry() -> Column:
    """Order of identifiers: smallest first, null last; repeated rows by their place in the log."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("rid").alias("rid"))


class DigestIndex:
    """The index: `append` logs a batch of documents and flushes it as a run, `probe` finds digests in the runs,
    `compact` merges all runs into one. Batches and compactions may follow each other in any order."""

    def __init__(self, scratch: Scratch, memtables: int = 4):
        self.scratch, self.memtables, self.made = scratch, memtables, 0
        self.logs: list[DataFrame] = []
        #: name, rows (digest, keep, n) and filter of each run
        self.runs: list[tuple[str, DataFrame, BitFilter]] = []

    def log(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.logs)

    def _add(self, rows: DataFrame, partition: list[str] | None = None) -> None:
        name = f"run{self.made}"
        self.made += 1
        run = self.scratch.write(rows, name, partition).select("digest", "keep", "n")
        self.runs.append((name, run, BitFilter(run, F.col("digest"))))

    def append(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """The batch's log: id, digest, rid."""
        batch = len(self.logs)
        entries = docs.select(F.col(id_col).alias("id"), _digest(normalised(F.col(text_col))).alias("digest")).withColumn("rid", F.monotonically_increasing_id() + F.lit(batch << 54))
        log = self.scratch.write(entries, f"log{batch}")
        memtable = F.pmod(F.shiftright("rid", 33), F.lit(self.memtables)).cast("int")
        flushed = log.groupBy(memtable.alias("run"), "digest").agg(F.min(_entry()).alias("keep"), F.count(F.lit(1)).alias("n"))
        self._add(flushed.sortWithinPartitions("run", "digest"), ["run"])
        self.logs.append(log)
        return log

    def probe(self, digests: DataFrame) -> DataFrame:
        """digest, keep, n of the given digests (column `digest`, any number of times) that the runs hold."""
        asked = digests.select("digest").distinct()
        found = [run.join(kept.keep(asked, F.col("digest")), "digest", "left_semi") for _, run, kept in self.runs]
        if not found:
            raise ValueError("the index has no runs")
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    def compact(self) -> DataFrame:
        """One row per digest: digest, keep (no_id, id, rid), n."""
        merged, old = self.runs, [name for name, _, _ in self.runs]
        rows = reduce(DataFrame.unionByName, [run for _, run, _ in merged]).groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        self.runs = []
        self._add(rows.sortWithinPartitions("digest"))
        self.scratch.drop(*old)
        return self.runs[0][1]

    def collisions(self, docs: DataFrame, text_col: str) -> DataFrame:
        """Digests whose texts are not the same bytes, after compaction; `docs` must hold all batches."""
        repeated = self.runs[0][1].filter("n > 1")
        norm = normalised(F.col(text_col))
        hits = BitFilter(repeated, F.col("digest")).keep(docs.select(norm.alias("norm")).select("norm", _digest(F.col("norm")).alias("digest")), F.col("digest"))
        return hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest (binary)."""
    scratch = scratch or Scratch(spark)
    index = DigestIndex(scratch)
    index.append(docs, id_col, text_col)
    compacted = index.compact()
    bad = scratch.write(index.collisions(docs, text_col), "collisions")
    log = index.log()
    total = log.count()
    if bad.limit(1).count():
        compacted, log = _by_text(scratch, docs, id_col, text_col, bad, compacted, log)
    joined = heavy_left_join(log, compacted, "digest", "n", total)
    return joined.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"), "digest")


def _by_text(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, bad: DataFrame, compacted: DataFrame, log: DataFrame):
    """Collided digests grouped by their bytes; the digest column carries the text behind a mark."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", _digest(F.col("norm"))).join(bad, "digest", "left_semi")
    rows = scratch.write(rows.select("id", F.concat(F.lit("bytes:").cast("binary"), F.col("norm").cast("binary")).alias("digest")).withColumn("rid", -F.monotonically_increasing_id() - 1), "collided")
    exact = rows.groupBy("digest").agg(F.min(_entry()).alias("keep"), F.count(F.lit(1)).alias("n"))
    return (compacted.join(bad, "digest", "left_anti").unionByName(exact), log.join(bad, "digest", "left_anti").unionByName(rows.select(*log.columns)))


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names."""
    scratch = Scratch(spark)
    decided = scratch.write(exact_dedup(spark, docs, id_col, text_col, scratch), "decided")
    gone = decided.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    if gone.filter("rows > 1 or id is null").limit(1).count():  # repeated or missing identifiers: decide by text as well
        marked = docs.select(F.struct(F.col(id_col).alias("v")).alias("id"), _digest(normalised(F.col(text_col))).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        kept = decided.filter("kept").select(F.struct(F.col("id").alias("v")).alias("id"), "digest")
        return marked.join(kept, ["id", "digest"], "left_semi").dropDuplicates(["digest"]).select("row.*")
    dropped = decided.filter("not kept").select(F.col("id").alias(id_col))
    return docs.join(dropped, id_col, "left_anti")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
"""
