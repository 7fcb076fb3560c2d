"""Cohort selection and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohort(df: DataFrame, column: str, part: str, columns: list[str]) -> DataFrame:
    """Rows whose column contains the part; reaches the scan as a pushed filter."""
    return df.filter(F.col(column).contains(part)).select(*columns)


def sample(df: DataFrame, n: int, key: str | list[str], seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones for the same seed; all rows if there are no more than n.

    Rows go by the MD5 of seed and key, which any engine can repeat; rows of equal keys are interchangeable.
    """
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(draw(keys, seed), *keys).limit(n)


def draw(keys: list[str], seed: int) -> Column:
    """The MD5 of seed and keys, by which samples go."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))


def sample_each(df: DataFrame, group: str, size: str, keys: list[str], seed: int = 42, parts: int = 64) -> DataFrame:
    """Of each group as many rows as its `size` says, the ones that `sample` takes. Groups are few.

    A first pass over draws alone finds each group's last one, in `parts` parts a group, of which only the first `size` draws each
    go on; rows up to the last draw are then taken by a second pass, so whole rows are moved for the sample only.
    """
    rows = df.withColumn("_draw", draw(keys, seed))
    draws = rows.select(F.col(group).alias("_group"), F.col(size).alias("_size"), "_draw").withColumn("_part", F.pmod(F.xxhash64("_draw"), F.lit(parts)))
    for by in (["_group", "_part"], ["_group"]):
        w = Window.partitionBy(*by).orderBy("_draw")
        draws = draws.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.col("_size")).drop("_rank")
    last = draws.groupBy("_group").agg(F.max("_draw").alias("_last"))  # one row a group
    rows = rows.join(F.broadcast(last), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_draw") <= F.col("_last")))
    w = Window.partitionBy(group).orderBy("_draw", *keys)  # equal draws go by all keys
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.col(size)).drop("_rank", "_draw", "_group", "_last", size)


def random_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows at random; with a seed the same ones as long as the rows come in the same partitions."""
    return df.orderBy(F.rand() if seed is None else F.rand(seed)).limit(n)
