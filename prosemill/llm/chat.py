"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

Chat logs often hold a conversation again after every turn. Each turn gets a 128-bit rolling hash of
all turns up to it (the xor of position-bound turn hashes, a running window). A conversation whose
last hash occurs in a longer conversation is a prefix of it; anti-joins keep the maximal ones, and
only these are rendered. Equal conversations keep the smallest identifier.

Prefixes are aggregated by hash before the join (map-side first), so a first turn that a third of all
conversations share is one row there; hot keys are joined by a bounded broadcast.

Defined results: turns are ordered by (turn, role, text), nulls first; null role and text render as
empty but differ from empty ones in comparisons; rows without conversation identifier are one
conversation; repeated rows are turns of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, heavy_left_join, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _turn_hash(salt: int) -> Column:
    said = [F.lit(salt), F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*said)


def rolling_prefixes(turns: DataFrame) -> DataFrame:
    """Turns with pos (from 1), n (turns of the conversation) and key (hash of all turns up to it)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = turns.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return out.withColumn("key", F.concat_ws("-", "pos", F.hex(F.bit_xor(_turn_hash(1)).over(up_to)), F.hex(F.bit_xor(_turn_hash(2)).over(up_to))))


def collapse(spark: SparkSession, turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, kept, keep_id."""
    scratch = scratch or Scratch(spark)
    rolled = scratch.write(rolling_prefixes(turns), "rolled")
    full = F.col("pos") == F.col("n")
    longest = F.struct((-F.col("n")).alias("n"), F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id"))
    prefixes = rolled.groupBy("key").agg(F.min(longest).alias("best"), F.count(F.when(full, 1)).alias("whole")).filter("whole > 0")
    prefixes = scratch.write(prefixes, "prefixes")
    whole = rolled.filter(full).select("conv_id", F.col("n").alias("n_turns"), "key")
    out = heavy_left_join(whole, prefixes, "key", "whole", whole.count())
    return out.select("conv_id", "n_turns", F.col("conv_id").eqNullSafe(F.col("best.id")).alias("kept"), F.col("best.id").alias("keep_id"))


def render(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, rendered."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    return turns.groupBy("conv_id").agg(F.array_join(said, "").alias("rendered"))


def chat_format(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, kept, keep_id and, if kept, rendered."""
    scratch = Scratch(spark)
    turns = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    decided = scratch.write(collapse(spark, turns, scratch), "decided")
    dropped = decided.filter("not kept").select(F.struct("conv_id").alias("_conv"))
    rolled = spark.read.parquet(scratch.path("rolled")).withColumn("_conv", F.struct("conv_id"))
    shown = render(rolled.join(dropped, "_conv", "left_anti").drop("_conv"))
    shown = shown.select(F.struct("conv_id").alias("_conv"), "rendered")
    return decided.withColumn("_conv", F.struct("conv_id")).join(shown, "_conv", "left").select("conv_id", "n_turns", "kept", "keep_id", "rendered")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark, table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
         CASE WHEN role IS NULL THEN 'n' ELSE 's' || role END || chr(0) || CASE WHEN text IS NULL THEN 'n' ELSE 's' || text END || chr(1) AS part
  FROM conversations),
p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(said, '') OVER w AS rendered, string_agg(part, '') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
best AS (SELECT pos, prefix, arg_min(conv_id, -n * 1000000000::HUGEINT + conv_id) AS keep_id FROM p GROUP BY pos, prefix)
SELECT p.conv_id, p.n AS n_turns, p.conv_id = best.keep_id AS kept, best.keep_id,
       CASE WHEN p.conv_id = best.keep_id THEN p.rendered END AS rendered
FROM p JOIN best USING (pos, prefix) WHERE p.pos = p.n
"""
