"""Writers: ordered CSV, the embedding store, SQL scripts and phrase lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import publish


#: the text that describes a store in its metadata (fixed value)
STORE_DESCRIPTION = "Drug embeddings: separate mappings for descriptions and ATC codes"

#: published names of the stages' columns (fixed values)
HEADERS = {"generic_name": "Generic Name", "drug_name": "Drug Name", "category": "Pharmacologic Category", "description": "Description", "atc_codes": "ATC Codes"}


def csv(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """Minimal quoting, rows in order: range-sorted parts, each with the header, whose names keep the order, so
    the write is parallel. `single` asks for one part, in one task, for programs that take one file."""
    out = df.orderBy(order).drop(order) if order else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def stage(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """A stage's output under its published column names, which the readers take; it replaces the former one whole."""
    out = df.select(*[F.col(c).alias(HEADERS.get(c, c)) for c in df.columns])
    publish.publish(df.sparkSession, path, lambda folder: csv(out, folder, order, single))


def report(df: DataFrame, path: str) -> None:
    """Drug, Avg_Similarity, highest first, ties by name."""
    out = df.select(F.col("item").alias("Drug"), F.col("avg_similarity").alias("Avg_Similarity")).orderBy(F.desc("Avg_Similarity"), "Drug")
    out.write.mode("overwrite").csv(path, header=True)


def embedding_store(df: DataFrame, path: str, model: str, description: str = STORE_DESCRIPTION) -> None:
    """Rows (embedding_type, drug_name, embedding) by type, as float32, and one row of metadata per type, with the
    totals of the store. Vectors of unlike lengths in one type are an error; a store without vectors has no types."""
    out = df.select("embedding_type", "drug_name", F.col("embedding").cast("array<float>"))
    out.write.mode("overwrite").partitionBy("embedding_type").option("compression", "gzip").parquet(f"{path}/vectors")
    stored = df.sparkSession.read.schema("drug_name string, embedding array<float>, embedding_type string").parquet(f"{path}/vectors")
    kinds = stored.groupBy("embedding_type").agg(F.count(F.lit(1)).alias("num_drugs"), F.max(F.size("embedding")).alias("embedding_dim"), F.min(F.size("embedding")).alias("least"))
    same = F.when(F.col("least") == F.col("embedding_dim"), F.col("embedding_dim")).otherwise(F.raise_error(F.lit("vectors of unlike lengths")).cast("int"))
    kinds = kinds.select("embedding_type", "num_drugs", same.alias("embedding_dim"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("embedding_type") == kind, F.col("num_drugs"))), F.lit(0)).alias(f"total_drugs_with_{kind}")
    totals = kinds.agg(total("description"), total("atc")).withColumnRenamed("total_drugs_with_description", "total_drugs_with_descriptions")
    meta = totals.join(kinds, F.lit(True), "left")  # one row each side but for the kinds, which are two
    meta.withColumn("model_name", F.lit(model)).withColumn("description", F.lit(description)).write.mode("overwrite").parquet(f"{path}/metadata")


def bucketed_store(df: DataFrame, name: str, buckets: int = 64) -> None:
    """Rows (embedding_type, drug_name, embedding) as a table of the session's catalog, dealt into buckets by drug_name and
    sorted in each: look-ups of a few names read their buckets only, joins with many do not shuffle the store."""
    out = df.select("embedding_type", "drug_name", F.col("embedding").cast("array<float>"))
    out.repartition(buckets, "drug_name").write.mode("overwrite").bucketBy(buckets, "drug_name").sortBy("drug_name").saveAsTable(name)


def phrases(df: DataFrame, path: str) -> None:
    """The phrase list (pos, phrase) as data, to be given to the removal step."""
    df.select("pos", "phrase").write.mode("overwrite").parquet(path)


def sql_lines(df: DataFrame, name: str) -> DataFrame:
    """pos, line of a script that drops, creates and fills a table of text columns."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate([name, *df.columns])], "i int, c string")
    clean = [r[0] for r in names.orderBy("i").select(X.identifier(F.col("c"))).collect()]  # one per column
    head = [f"DROP TABLE IF EXISTS {clean[0]};", f"CREATE TABLE {clean[0]} ({', '.join(f'{c} TEXT' for c in clean[1:])});"]
    values = F.concat(F.lit(f"INSERT INTO {clean[0]} VALUES ("), F.concat_ws(", ", *[X.sql_literal(F.col(f"`{c}`").cast("string")) for c in df.columns]), F.lit(");"))
    top = spark.createDataFrame([(i - 2, x) for i, x in enumerate(head)], "pos long, line string")
    return top.unionByName(df.select(F.monotonically_increasing_id().alias("pos"), values.alias("line")))


def sql_script(df: DataFrame, name: str, path: str) -> None:
    sql_lines(df, name).orderBy("pos").select("line").write.mode("overwrite").text(path)
