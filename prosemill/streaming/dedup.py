"""Deterministic dedup on streams: one row a key in keyed state, given out anew whenever a later batch touches the key.

Rows come in any order within the watermark. State holds the best row so far of a key and a span of event time, as a
streaming aggregation; spans are as long as the watermark's delay and `idle` together, and a span is dropped once the
watermark has passed its end, so the state holds the keys of that time and not of all time. Of all rows given out for a
key the best is the result, the same as the batch operators give over all rows of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: provider that keeps state on disk and not in the executors' memory
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
WAY = "prosemill.best"  # metadata of the column that rows are ordered by: first or last


def _best(row: Column, order: str, last: bool) -> Column:
    """The row with the smallest (or largest) `order`; rows without it come after all others."""
    return F.max_by(row, F.struct(F.isnotnull(order), order)) if last else F.min_by(row, F.struct(F.isnull(order), order))


def best_rows(stream: DataFrame, keys: list[str], order: str, time: str, last: bool = False, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """The rows of `stream` that are, when they are given out, the first (last) of their keys and spans by `order`. Rows
    later than the watermark, and rows without a time, are dropped. `delay` is given in weeks or smaller units."""
    span = F.window(time, f"{delay} {idle_ms} milliseconds")
    row = F.struct(*[c for c in stream.columns if c not in keys])
    best = stream.withWatermark(time, delay).groupBy(span.alias("_span"), *keys).agg(_best(row, order, last).alias("_row"))
    of = {c: F.col(c) if c in keys else F.col("_row")[c] for c in stream.columns}
    return best.select(*[of[c].alias(c, metadata={WAY: "last" if last else "first"}) if c == order else of[c].alias(c) for c in stream.columns])


def first_in_stream(stream: DataFrame, keys: list[str], order: str, time: str, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    return best_rows(stream, keys, order, time, False, delay, idle_ms)


def last_in_stream(stream: DataFrame, keys: list[str], order: str, time: str, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    return best_rows(stream, keys, order, time, True, delay, idle_ms)


def drain(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """All that is there now, batch after batch, into `path`, a folder per batch: a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def latest(given: DataFrame, keys: list[str]) -> DataFrame:
    """Of what was drained, the best row of each key, by the column and the way that `best_rows` has marked."""
    order, way = next((f.name, f.metadata[WAY]) for f in given.schema.fields if WAY in f.metadata)
    rest = [c for c in given.columns if c not in keys and c != "batch"]
    return given.groupBy(*keys).agg(_best(F.struct(*rest), order, way == "last").alias("_row")).select(*keys, "_row.*")
