"""Blocks of text are rows of up to tens of MB."""

import glob

import pyarrow.parquet as pq
from prosemill.llm import importance, token_align
from prosemill.llm.common import Scratch
from pyspark.sql import functions as F


def test_row_groups_hold_few_blocks(spark):
    """Twelve rows of 4 MB were one row group, which a task wrote and read at once."""
    rows = spark.range(0, 12, 1, 1).select("id", F.expr("array_join(transform(sequence(1, 65536), x -> sha2(cast(x + id * 65536 as string), 256)), '')").alias("words"))
    scratch = Scratch(spark)
    assert scratch.write(rows, "blocks", **importance.ROW_GROUPS).count() == 12
    groups = [g for f in glob.glob(f"{scratch.path('blocks').removeprefix('file://')}/*.parquet") for g in [pq.ParquetFile(f).metadata]]
    assert sum(g.num_rows for g in groups) == 12 and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 6


def test_aligned_blocks_are_small_rows_in_small_row_groups(spark, monkeypatch):
    """A block of 1 MB took 200 MB of a worker, and all blocks of a task were one row group, which readers of lists hold at once."""
    monkeypatch.setitem(token_align.ROW_GROUPS, "parquet.block.size", str(1 << 17))
    words = F.expr("array_join(transform(sequence(1, 200), x -> concat(elt(1 + pmod(hash(x, id), 7), 'the', 'of', 'sea', 'stone', 'river', 'über', 'x'), pmod(hash(id, x), 1000))), ' ')")
    texts = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    made = token_align.Alignment(spark, texts)
    assert made.documents().count() == 1000
    assert made.blocks.count() >= n_bytes / (1 << 18) > 4
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{made.scratch.path('blocks').removeprefix('file://')}/*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 2
