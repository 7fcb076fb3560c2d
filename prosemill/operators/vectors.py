"""Embeddings: encoding, lookup, pairwise similarity and reports over it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from .cosines import Cosines


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


#: items of a cohort that one block of pairs takes from either side, about
BLOCK = 256


def in_blocks(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """`items` (cohort, item, ...) with `own` and `other`: a row per block of the cohort, so that pairs of items meet
    in the cell (own, other) of a grid and a large cohort is spread over as many tasks as it has cells."""
    sizes = items.groupBy("cohort").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = items.join(sizes, "cohort").withColumn("own", F.expr("cast(pmod(xxhash64(item), blocks) as int)"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def pairs(items: DataFrame, cohort: str, item: str, vector: str) -> DataFrame:
    """cohort, i, j, sim for i < j within each cohort. Reports over them need no row per pair: `cosines.Cosines`."""
    return Cosines(items, cohort, item, vector).pairs()


def pair_stats(sims: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """n_pairs, mean, population deviation, smallest and largest, per cohort. With `sizes` (cohort, size: the length
    of each item's vector) also the range over the whole matrix, whose diagonal is 1, or 0 for vectors of length 0."""
    out = sims.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("sim").alias("mean_sim"), F.stddev_pop("sim").alias("std_sim"), F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"))
    if sizes is None:
        return out
    return with_range(out, sizes)


def with_range(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """`stats` with the range over the whole matrix, from the lengths of the items' vectors (cohort, size)."""
    self_sim = F.when(F.col("size") > 0, 1.0).otherwise(0.0)
    own = sizes.groupBy("cohort").agg(F.min(self_sim).alias("low"), F.max(self_sim).alias("high"))
    return stats.join(own, "cohort").withColumns({"range_min": F.least("min_sim", "low"), "range_max": F.greatest("max_sim", "high")}).drop("low", "high")


def ranked(sims: DataFrame, by: tuple[str, ...] = ("cohort",)) -> DataFrame:
    """Pairs with their place (from 0) in their group by similarity to nine places, ties by (i, j), and the group's number.

    Pairs are range-partitioned in that order and written; places follow from the number of pairs of each group and
    partition, so a group of many pairs is no single task.
    """
    out = placed(sims.withColumn("down", -F.round("sim", 9)), by, ["down", "i", "j"])
    return out.select(*sims.columns, "place", "total")


def placed(rows: DataFrame, by: tuple[str, ...], within: list[str]) -> DataFrame:
    """`rows` with their place (from 0) in their group by the columns `within`, and the group's number."""
    spark, path = rows.sparkSession, shared.new_folder(rows.sparkSession, "ranked")
    columns, order = rows.columns, [*by, *within]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    counts = rows.groupBy(*by, "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    return rows.join(counts, [*by, "part"]).withColumn("place", F.col("seq") + F.col("shift")).select(*columns, "place", "total")


def levels(sims: DataFrame, n: int | None = None, bins: int = 1024) -> DataFrame:
    """cohort, band (top, middle, bottom), place in band, and the pair. Bands have `n` pairs or, without it, as
    many as the cohort has items (m items have m (m - 1) / 2 pairs). Bands may overlap in small cohorts.

    A first pass counts each cohort's pairs in `bins` bins of similarity, which says in which of them a band begins, runs
    or ends; only the pairs of those bins are then sorted and written.
    """
    spark, path = sims.sparkSession, shared.new_folder(sims.sparkSession, "bins")
    binned = sims.withColumn("bin", F.least(F.lit(bins - 1), F.floor((1.0 - F.round("sim", 9)) * bins)).cast("int"))
    binned.groupBy("cohort", "bin").agg(F.count(F.lit(1)).alias("held")).write.parquet(path)  # at most `bins` rows a cohort
    w = Window.partitionBy("cohort")
    before = F.coalesce(F.sum("held").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = spark.read.parquet(path).withColumns({"before": before, "pairs": F.sum("held").over(w)})
    size = F.lit(n) if n is not None else F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long")
    start = {"top": F.lit(0), "middle": F.floor(F.col("pairs") / 2), "bottom": F.greatest(F.lit(0), F.col("pairs") - size)}
    touched = F.lit(False)
    for s in start.values():
        touched = touched | ((F.col("before") < s + size) & (F.col("before") + F.col("held") > s))
    chosen = counts.filter(touched).select("cohort", "bin", "before", "pairs")
    r = ranked(binned.join(chosen, ["cohort", "bin"]), ("cohort", "bin")).withColumn("place", F.col("place") + F.col("before"))
    bands = [r.filter((F.col("place") >= s) & (F.col("place") < s + size)).select("cohort", F.lit(b).alias("band"), (F.col("place") - s).cast("long").alias("place"), "i", "j", "sim") for b, s in start.items()]
    return bands[0].unionByName(bands[1]).unionByName(bands[2])


def marked(banded: DataFrame) -> DataFrame:
    """The first, middle and last pair of each band: cohort, band, mark, i, j, sim; one pair may have several marks.
    The middle is place n / 2, n being the items of the cohort (as many as a whole band has pairs) or, in a band cut
    short, its number of pairs."""
    size = banded.groupBy("cohort", "band").agg(F.max("place").alias("last"))
    at = {"top": F.lit(0), "middle": F.floor((F.col("last") + 1) / 2), "bottom": F.col("last")}
    marks = F.filter(F.array(*[F.when(F.col("place") == p, F.lit(m)) for m, p in at.items()]), lambda m: m.isNotNull())
    return banded.join(size, ["cohort", "band"]).select("cohort", "band", F.explode(marks).alias("mark"), "i", "j", "sim")


def named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with `display` of both items in place of their numbers; names (cohort, item, display)."""
    for side in ("i", "j"):
        pairs = pairs.join(names.withColumnRenamed("item", side), ["cohort", side]).drop(side).withColumnRenamed("display", f"name_{side}")
    return pairs


def level_means(banded: DataFrame) -> DataFrame:
    return banded.groupBy("cohort", "band").agg(F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("n_pairs"))


def per_item(items: DataFrame, cohort: str, item: str, sims: DataFrame) -> DataFrame:
    """cohort, item, avg_similarity to all other items; 0 for a single item."""
    both = sims.select("cohort", F.col("i").alias("item"), "sim").unionByName(sims.select("cohort", F.col("j").alias("item"), "sim"))
    mean = both.groupBy("cohort", "item").agg(F.avg("sim").alias("avg_similarity"))
    every = items.select(F.col(cohort).alias("cohort"), F.col(item).alias("item"))
    return every.join(mean, ["cohort", "item"], "left").withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0)))


def lookup(requests: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """Requests that the store has, with its vector; of repeated names the last stored one."""
    last = store.groupBy(key).agg(F.max_by("embedding", order).alias("embedding"))
    return requests.join(last, key)


def missing(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return requests.join(store.select(key).distinct(), key, "left_anti")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reports (dataset, avg_similarity) side by side; a missing side is null."""
    side = lambda df, s: df.groupBy("dataset").agg(F.avg("avg_similarity").alias(f"mean_{s}"), F.stddev_samp("avg_similarity").alias(f"std_{s}"))
    out = side(a, "a").join(side(b, "b"), "dataset", "full_outer")
    return out.withColumn("difference", F.abs(F.col("mean_a") - F.col("mean_b")))


def accuracy(predicted: DataFrame, actual: DataFrame, order: str) -> DataFrame:
    """Share of positions where both sequences agree; an error if one is missing."""
    out = predicted.join(actual, order, "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual").isNull()).alias("gone"), F.count_if(F.col("predicted") == F.col("actual")).alias("same"))
    checked = F.when((F.col("n") == 0) | (F.col("gone") > 0), F.raise_error(F.lit("no predictions, or fewer actual values")).cast("double")).otherwise(F.col("same") / F.col("n"))
    return out.select(F.col("n"), checked.alias("accuracy"))


def device(configured: str = "") -> str:
    """The device for a model: a graphics card where a worker has one, else the configured one, else the CPU.
    Called in the worker that loads the model; a library that tells is optional."""
    try:
        import torch
    except ImportError:
        return configured or "cpu"
    return "cuda" if torch.cuda.is_available() else configured or "cpu"


def hashing_encoder(dim: int = 64, configured: str = "") -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A deterministic encoder for use without a model: signed hashing of words by MD5, at length 1.

    Any function that makes a predict function for batches of texts can stand in its place; a model is loaded
    inside, once per worker, on `device(configured)`, for which this encoder has no use. Words stand between the
    white space of `str.split`.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        import hashlib

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in str(t).lower().split():
                    h = hashlib.md5(w.encode()).digest()
                    out[i, h[0] % dim] += 1.0 if h[1] & 1 else -1.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1)

        return predict

    return make


def encode(c: Column, make: Callable, batch: int = 256) -> Column:
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)(c)
