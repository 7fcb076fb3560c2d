"""Shared helpers: the shared folder, written intermediate tables, and skew-safe native joins.

Every intermediate that is read twice is written to the folder that the session names in
`spark.checkpoint.dir` and read back, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyfilter import KeyFilter as KeyFilter
from ..sources import shared

#: Arrow batches of the Python operators: rows and, where Spark knows the setting, bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: For tables whose rows are blocks of texts: row groups are cut after each few, or writers and readers hold a hundred such rows, or all of a task.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Written tables of one query, each in a folder of its own under the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = shared.new_folder(spark, "prosemill")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, partition: list[str] | None = None, **options: str) -> DataFrame:
        writer = df.write.mode("overwrite").options(**{"compression": "zstd", **options})
        (writer.partitionBy(*partition) if partition else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))  # also where no file was written

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column that tells rows apart in stages that filter.
KEY = "_prosemill_key"


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """`docs` with the column KEY, and whether keys repeat. The key is the identifier; if identifiers are
    null or repeated, it is (no identifier, identifier, SHA-256 of the text), which is never null."""
    per_id = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if not per_id.filter("n > 1 or id is null").limit(1).count():
        return docs.withColumn(KEY, F.col(id_col)), False
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return docs.withColumn(KEY, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.alias("text"))), True


def hot_share(total: int) -> int:
    """Size from which a group counts as hot: fewer than 1,000 groups of a table can reach it."""
    return max(1024, total // 1000)


def heavy_left_join(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`left` left-joined to `right`, which is unique on `key` and whose `size` says how many rows of
    `left` have that key. Keys of a thousandth of all rows or more, of which there are at most 1,000,
    are broadcast; so no task of the shuffled rest gets more than a thousandth of `left` for one key.
    """
    limit = hot_share(total)
    hot = F.broadcast(right.filter(F.col(size) >= limit))
    warm = right.filter(F.col(size) < limit)
    rest = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(warm, key, "left"))


class BitFilter:
    """A fixed-size set filter built and tested by built-in functions: no false negatives.

    One bit per hash value, in bitmaps of 32,768 bits; with 2**26 bits the whole filter is at most
    2,048 rows of 4 KB (8 MB) whatever it holds, which is what makes the broadcast safe. When more
    values than bits come in it lets everything pass; callers must only rely on what it rejects.
    """

    def __init__(self, values: DataFrame, value: Column, bits: int = 1 << 26):
        at = F.pmod(F.xxhash64(value), F.lit(bits)) + F.lit(1)
        self.bits = bits
        self.maps = values.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))

    def keep(self, df: DataFrame, value: Column) -> DataFrame:
        at = F.pmod(F.xxhash64(value), F.lit(self.bits)) + F.lit(1)
        held = df.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
        byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.expr("1").cast("int") == F.call_function("getbit", byte, F.expr("cast(_bit % 8 as int)")).cast("int")
        return held.join(F.broadcast(self.maps), "_bucket").filter(is_set).drop("_bucket", "_bit", "_map")
