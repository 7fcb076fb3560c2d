"""A set of 64-bit keys for tasks in Python, in a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyFilter:
    """The values of the long column `key` without false negatives. It has eight bits a key or more, but `MOST_BITS`
    (32 MB) at most, so its size is bounded before it is collected and broadcast; with more keys it lets more through."""

    LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

    def __init__(self, spark: SparkSession, keys: DataFrame, part: int = 0, parts: int = 1):
        """Of `keys` the ones of a part, which `has` asks for too; the parts share all keys out."""
        self.part, self.parts = part, parts
        keys = keys.filter(F.pmod(F.shiftrightunsigned("key", 33), F.lit(parts)) == part) if parts > 1 else keys
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, 1 << (8 * keys.count()).bit_length()))
        at = F.col("key").bitwiseAND(self.bits - 1)
        rows = keys.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
        packed = np.zeros(max(self.bits // 8, 4096), np.uint8)
        for part, held in rows.collect():  # at most 8,192 rows of 4 KB
            packed[part << 12 : (part << 12) + 4096] = np.frombuffer(held, np.uint8)
        self.packed = spark.sparkContext.broadcast(packed)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.uint64) & np.uint64(self.bits - 1)).astype(np.int64)
        held = (self.packed.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        if self.parts > 1:
            held &= (keys.view(np.uint64) >> np.uint64(33)) % np.uint64(self.parts) == self.part
        return held

    @classmethod
    def shared(cls, spark: SparkSession, keys: DataFrame) -> list[KeyFilter]:
        """Filters that share out `keys`, as many as they need to have four bits a key or more within `MOST_BITS` each. So
        none fills up, whatever the number of keys; each is for a pass of its own."""
        parts = max(1, -(-4 * keys.count() // cls.MOST_BITS))
        return [cls(spark, keys, part, parts) for part in range(parts)]
