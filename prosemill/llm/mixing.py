"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; a document of it is owed target / source size copies.
The whole copies are given, and the fractional rest of all documents is rounded together: two
documents at a time, words move at random from one to the other until one of the two fractions is 0
or 1, in the direction chosen so that expectations hold. The moves keep the words of the pair, so a
source's words come to its target but for the last document that is still fractional; that one takes the
words of its fraction instead of a whole copy, so the source misses its target by half a word at most.

Documents of a source are dealt over leaves by a hash of their identifiers; each leaf is rounded in
one task and leaves one fractional document, and these residuals go up a tree of fan-in `FAN_IN`, so
a source with a third of all rows is no larger task than any other. Randomness comes from hashes of
data, so reruns agree and nothing depends on partitions.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in
order; repeated rows are rounded each on its own; an empty table gives an empty result; other
columns are not read. No document takes more than `CAP` times its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, heavy_left_join, table

WEIGHTS, CAP, LEAF, FAN_IN, SEED = (5, 2, 1), 3, 2048, 64, 42


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, n, source_size, rank, target.

    Sharing by weight, cutting at the cap and resharing the excess ends at target = least(cap, level x
    weight). In ascending order of cap / weight, the level with all earlier sources cut first rises
    and then falls; its highest value is the final one. Windows here run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("rank", F.row_number().over(in_order))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.lit(cap) * F.col("source_size"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(everything))
    by = by.withColumn("level", (F.col("total") - before) / left)
    level = F.max("level").over(everything)
    return by.select("source", "n", "source_size", "rank", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def _round(level: int, last: bool):
    """Rounds one node of the tree; columns node, rank, id, place, size, whole, part, done."""

    def node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "place"], ascending=[False, True], kind="stable")
        size, part = rows["size"].to_numpy(np.float64), rows["part"].to_numpy(np.float64).copy()
        rng = np.random.default_rng([SEED, level, int(rows["rank"].iat[0]), int(rows["node"].iat[0])])
        draw = rng.random(len(rows))
        held = -1  # the one row that is still fractional
        for i in np.flatnonzero((part > 0) & (part < 1) & (size > 0)).tolist():
            if held < 0:
                held = i
                continue
            up = min(size[i] * (1 - part[i]), size[held] * part[held])  # words that could move to i
            down = min(size[i] * part[i], size[held] * (1 - part[held]))
            moved = up if draw[i] * (up + down) < down else -down
            part[i] += moved / size[i]
            part[held] -= moved / size[held]
            for j in (i, held):
                part[j] = 0.0 if part[j] < 1e-9 else 1.0 if part[j] > 1 - 1e-9 else part[j]
            held = i if 0 < part[i] < 1 else held if 0 < part[held] < 1 else -1
        rows["part"] = part
        rows["done"] = (part == 0) | (part == 1) | (size == 0) | last
        return rows

    return node


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, copies (whole ones), taken (words, those of
    the copies and of a last part)."""
    scratch = Scratch(spark)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    targets = scratch.write(source_targets(sizes, weights, cap), "targets")
    facts = targets.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    total, leaves = facts["rows"] or 0, max(1, -(-(facts["most"] or 0) // LEAF))

    # joined by a key that is never null: heavy_left_join meets equal keys only
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    dealt = heavy_left_join(sizes.withColumn("key", key).drop("source"), targets.withColumn("key", key).drop("source"), "key", "n", total)
    place = F.xxhash64(F.lit(SEED), F.col("id"), F.col("size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(share + F.lit(1e-12))
    part = F.greatest(F.lit(0.0), share - whole)
    node = F.pmod(place, F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(LEAF))))
    state = dealt.select("id", "size", "source_size", "target", "rank", place.alias("place"), whole.alias("whole"), F.when(part < 1e-9, 0.0).otherwise(part).alias("part"), node.alias("node"), F.lit(False).alias("done"))
    decided, level = None, 0
    while True:
        rounded = scratch.write(state.groupBy("rank", "node").applyInPandas(_round(level, leaves == 1), state.schema), f"level{level}")
        over = rounded.filter("done")
        decided = over if decided is None else decided.unionByName(over)
        if leaves == 1:
            break
        state, leaves, level = rounded.filter("not done").withColumn("node", F.expr(f"node div {FAN_IN}")), -(-leaves // FAN_IN), level + 1
    copies = (F.col("whole") + F.floor("part")).cast("long")
    rest = F.round((F.col("part") - F.floor("part")) * F.col("size")).cast("long")
    return decided.select("id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size") + rest).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
