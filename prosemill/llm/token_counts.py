"""Token counts from an exact length histogram.

Documents are encoded with a public byte-level BPE vocabulary (its path is a parameter) and
aggregated by encoded length. Suffix sums over the histogram then answer, for every context limit,
how many documents and tokens reach it, what remains after truncation, and the quantiles.

The histogram has one row per distinct length, whatever the number of documents, and is aggregated
map-side, so a hot length costs nothing. Suffix sums run in two levels (blocks of `BLOCK` lengths,
then inside blocks), so no task reads the whole histogram.

The splitting pattern looks ahead over white space, which exhausts the encoder on runs of about a million
characters; runs of `LONG_WHITE` or more are therefore encoded as the one piece that the pattern makes
of them, with the same tokens as a whole.

Defined results: null and empty texts have length 0; an empty table gives an empty histogram; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
#: White space as the pattern's `\s` has it, and from how many characters on a run is cut out.
WHITE_SPACE, LONG_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", 10_000
_encodings: dict = {}


def encoding(path: str = VOCABULARY):
    """The encoder of a vocabulary file, once per Python worker."""
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(encoder, text: str, long_white: int = LONG_WHITE) -> int:
    """How many tokens the text has. A run of white space is one piece, but for its last character
    when a word follows."""
    total, at = 0, 0
    for run in re.finditer(f"{WHITE_SPACE}{{{long_white},}}", text) if len(text) >= long_white else ():
        end = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def token_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            lengths = pa.array([count_tokens(encoder, t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([lengths], names=["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    return token_lengths(docs, text_col, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram: documents and tokens of that length, of at least it, the tokens
    left when all texts are cut at L, and the share of documents not longer than L."""
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.join(blocks, "block").withColumn("docs_at_least", F.col("d") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("t") + F.sum("tokens").over(inside))
    cut = F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    up_to = F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", cut.alias("truncated_total"), up_to.alias("docs_up_to"), (up_to / F.col("all_d")).alias("quantile"))


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share `q` of the documents does not exceed."""
    return answers.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every text is cut at `limit`, which need not be a length that occurs."""
    over = F.when(F.col("n_tokens") > limit, F.col("n_docs") * limit).otherwise(F.col("tokens"))
    return answers.agg(F.coalesce(F.sum(over), F.lit(0)).alias("tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return limits(scratch.write(length_histogram(table(spark, sf_dir, "documents")), "histogram"))
