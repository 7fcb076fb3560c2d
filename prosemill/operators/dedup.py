"""Deterministic dedup: first wins, last wins, and last value at first position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` of each key. Aggregated map-side, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def last_value_first_place(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the last non-blank value and the place where the key was first seen with one."""
    some = df.filter(F.trim(value) != "")
    return some.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_place"))


def scrape_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """total, unique and duplicates in one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_rows"))
    return out.select("total", (F.col("total") - F.col("unique_rows")).alias("duplicates"), "unique_rows")
