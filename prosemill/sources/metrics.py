"""Counters that a stage gathers in the pass that writes it, without reading anything again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Named aggregates observed on rows as they pass: `watch` before an action, read by index after it.

    Rows are counted where `watch` stands, so it belongs before a shuffle, or after the last one, of the action: what
    a sort by ranges reads twice, for its sample and for itself, would be counted twice.
    """

    def __init__(self) -> None:
        self._held: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
        self._held[name] = Observation(name)
        return df.observe(self._held[name], *[c.alias(n) for n, c in aggregates.items()])

    def __getitem__(self, name: str) -> dict:
        return self._held[name].get

    def row(self) -> dict:
        """All counters by `name_aggregate`."""
        return {f"{name}_{k}": v for name, seen in self._held.items() for k, v in seen.get.items()}


def rows() -> Column:
    return F.count(F.lit(1))


def removal(before: str, after: str) -> dict[str, Column]:
    """processed, changed (fewer bytes) and emptied of a removal from the column `before` to `after`."""
    return {"processed": rows(), "changed": F.count_if(F.octet_length(after) < F.octet_length(before)), "emptied": F.count_if((F.col(before) != "") & (F.col(after) == ""))}


def matching() -> dict[str, Column]:
    """matched, unmatched, cleaned and empty of enriched products."""
    return {"matched": F.count_if("matched"), "unmatched": F.count_if(~F.col("matched")), "cleaned": F.count_if(F.col("matched") & F.col("cleaned")), "empty": F.count_if(F.col("matched") & ~F.col("cleaned"))}
