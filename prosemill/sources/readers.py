"""Readers: CSV variants, the knowledge-base XML, the embedding store and TOML configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from . import records
from .publish import current
from .shared import require

ENTITY = "name array<string>, description array<string>, indication array<string>, `atc-codes` struct<`atc-code`: array<struct<_code: string>>>, `atc-code` array<struct<_code: string>>"


def numbered(df: DataFrame) -> DataFrame:
    """Rows just read from files, with row_id: 0, 1, ... in the order of the files' paths and of the rows in each.

    Spark packs file splits into tasks by size, so its own row numbers follow no file. Rows are counted per split,
    and the splits, one row each, are summed up in order.
    """
    places = {"_row_file": F.col("_metadata.file_path"), "_row_start": F.col("_metadata.file_block_start"), "_row_seq": F.monotonically_increasing_id()}
    rows = df.select("*", *[c.alias(n) for n, c in places.items()])
    splits = rows.groupBy("_row_file", "_row_start").agg(F.min("_row_seq").alias("_row_first"), F.count(F.lit(1)).alias("_row_count"))
    before = F.sum("_row_count").over(Window.orderBy("_row_file", "_row_start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_row_file", "_row_start", "_row_first", F.coalesce(before, F.lit(0)).alias("_row_before"))
    row_id = (F.col("_row_before") + F.col("_row_seq") - F.col("_row_first")).alias("row_id")
    return rows.join(splits, ["_row_file", "_row_start"]).select(*df.columns, row_id)


CSV = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, row_id: bool = True, header: bool = True) -> DataFrame:
    """All columns as strings, empty cells as '', malformed rows fail; optionally some columns and the row order.

    Cells may hold line breaks: files are split among tasks wherever they have them. A first scan counts quotes; only
    where a line has an odd number of them are rows put together of lines (`records.joined`). A file that ends inside a
    quoted cell is an error. Files without header get names _c0, _c1, ...
    """
    require(spark, path, "CSV file")
    path = current(spark, path)
    lines = records.pieces(spark, path, "\n").withColumn("odd", records.quotes(F.col("value")))
    per_file = lines.groupBy("file").agg(F.sum("odd").alias("odd"))
    odd, broken = per_file.agg(F.sum("odd"), F.max(F.col("odd") % 2)).first()
    if broken:
        raise ValueError(f"{path}: a file ends inside a quoted cell")
    if odd:
        df = _over_lines(spark, path, lines, header)
    else:
        df = numbered(spark.read.csv(path, header=header, **CSV))
    df = df if row_id else df.drop("row_id")
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns], *(["row_id"] if row_id else []))
    return df.fillna("")


def _over_lines(spark: SparkSession, path: str, lines: DataFrame, header: bool) -> DataFrame:
    """Rows of CSV files whose cells hold line breaks, with row_id."""
    whole = records.joined(lines, F.col("odd"), "\n", 2, F.col("value").isin("", "\r"))
    whole = whole.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    names = spark.read.csv(path, header=header, multiLine=True, **CSV).columns
    first = whole.groupBy("file").agg(F.min("record").alias("first"))
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    heads = first.select("file", "first", (F.coalesce(F.count(F.lit(1)).over(order), F.lit(0)) + 1).alias("heads"))  # one row per file
    rows = whole.join(F.broadcast(heads), "file").filter(F.col("record") > F.col("first")) if header else whole.withColumn("heads", F.lit(0))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    cells = rows.select(F.from_csv("value", schema, {**CSV, "multiLine": "true"}).alias("row"), (F.col("record") - F.col("heads")).alias("row_id"))
    return cells.select("row.*", "row_id")


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["Generic Name", "Brand Name", "Pharmacologic Category"])


def scraped(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["Generic Name", "Drug Name", "Pharmacologic Category"])


def enriched(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["Generic Name", "Drug Name", "Description", "ATC Codes"])


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, ["Generic Name", "Description"])


def boiled(spark: SparkSession, path: str) -> DataFrame:
    """Missing-value tokens as ''; the ATC column is optional."""
    df = csv(spark, path)
    for c in df.columns[:-1]:
        df = df.withColumn(c, F.when(F.col(f"`{c}`").isin(*C.NA_TOKENS), "").otherwise(F.col(f"`{c}`")))
    return df if "ATC Codes" in df.columns else df.withColumn("ATC Codes", F.lit(""))


def cohort(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Three columns renamed by position; any other number is an error."""
    df = csv(spark, path, row_id=row_id)
    if len(df.columns) != 3 + row_id:
        raise ValueError(f"{path}: expected 3 columns, found {len(df.columns) - row_id}")
    return df.toDF("generic_name", "drug_name", "description", *(["row_id"] if row_id else []))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """First column of a file without header, with its positions from 0."""
    require(spark, path, "truth file")
    return csv(spark, path, header=False).select(F.col("_c0").alias("actual"), "row_id")


def reports(spark: SparkSession, glob: str) -> DataFrame:
    """Per-item reports of a folder, with the dataset taken from each file's name."""
    df = spark.read.schema("item string, avg_similarity double").csv(glob, header=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+_sims\.csv)(?:/[^/]+)?$", 1)
    return df.withColumn("dataset", X.dataset_label(name))


def dictionary_rows(entities: DataFrame) -> DataFrame:
    """Entities (name, description, indication, atc_codes, seq) keyed by name, last one wins; entities
    without a name or any content drop out."""
    some = entities.filter((F.col("name") != "") & ((F.col("description") != "") | (F.col("indication") != "") | (F.size("atc_codes") > 0)))
    keyed = some.withColumn("name_key", X.name_key(F.col("name"))).filter("name_key <> ''")
    best = keyed.groupBy("name_key").agg(F.max_by(F.struct("description", "indication", "atc_codes"), "seq").alias("e"))
    return best.select("name_key", "e.*")


def parse_entities(rows: DataFrame) -> DataFrame:
    """Rows of ENTITY to name, description, indication and atc_codes: the first non-empty element of each."""
    first = lambda c: F.coalesce(F.get(F.filter(F.transform(F.col(c), X.strip), lambda x: x != ""), F.lit(0)), F.lit(""))
    none = F.array().cast("array<string>")
    codes = F.concat(F.coalesce(F.col("`atc-codes`.`atc-code`._code"), none), F.coalesce(F.col("`atc-code`._code"), none))
    return rows.select(first("name").alias("name"), first("description").alias("description"), first("indication").alias("indication"), codes.alias("atc_codes"), *[c for c in rows.columns if c == "seq"])


def knowledge_base(spark: SparkSession, path: str, row_tag: str = "drug", strict: bool = False) -> DataFrame:
    """The entity dictionary of XML files, read by byte ranges. An element ends with its own end tag and holds the ones
    nested in it; self-closing codes count. In the strict form the first end tag, be it a nested element's, closes an
    entity, what follows up to the next begin is left out, and only codes with an end tag count (`records.strict_entity`)."""
    require(spark, path, "knowledge base")
    if strict:
        ends = numbered(spark.read.text(path, lineSep=f"</{row_tag}>"))
        return dictionary_rows(records.strict_entities(ends, row_tag))
    whole = records.elements(spark, path, row_tag)
    # as the element of an array, so that filters of later columns do not parse the element again
    rows = whole.select(F.explode(F.array(F.from_xml("value", ENTITY, {"mode": "FAILFAST"}))).alias("e"), F.col("record").alias("seq")).select("e.*", "seq")
    return dictionary_rows(parse_entities(rows))


def embedding_store(spark: SparkSession, path: str, kind: str = "description") -> DataFrame:
    """drug_name, embedding of one kind; only its partition is read. A missing store or kind is an error."""
    require(spark, f"{path}/vectors", "embedding store")
    require(spark, f"{path}/vectors/embedding_type={kind}", f"embeddings of type {kind}")
    return spark.read.parquet(f"{path}/vectors").filter(F.col("embedding_type") == kind)


def bucketed_vectors(spark: SparkSession, name: str, requests: DataFrame, kind: str = "description") -> DataFrame:
    """`requests` (drug_name, ...) with the vectors that a bucketed store has for them; the store is not shuffled."""
    return requests.join(spark.table(name).filter(F.col("embedding_type") == kind).hint("merge"), "drug_name")


def store_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per kind of embeddings, each with the totals of the store."""
    return spark.read.parquet(require(spark, f"{path}/metadata", "embedding store"))


def config(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)
