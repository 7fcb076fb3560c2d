"""Records that go over line ends, read from byte ranges of a file by many tasks.

A file is read as pieces between separators, which Spark finds from any byte on. Whether a piece ends a record depends
on all before it: on how many quotes or open elements they leave. That is a sum: pieces are summed up within each byte
range, ranges are summed up in their order, one row a range, and with the sum at its begin every range knows its own
records. Only the pieces of records that have several are brought together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, start (of the byte range), seq (order within it), value."""
    text = spark.read.text(path, lineSep=separator)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), "value")


def _before(rows: DataFrame, value: Column, name: str, within_file: bool) -> DataFrame:
    """file, start and the sum of `value` over all earlier byte ranges; one row per range, so joins broadcast it and leave
    the texts where they are."""
    sums = rows.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
    order = Window.partitionBy("file").orderBy("start") if within_file else Window.orderBy("file", "start")
    return sums.select("file", "start", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))


def joined(parts: DataFrame, change: Column, separator: str, modulus: int | None = None, blank: Column | None = None) -> DataFrame:
    """file, record (from 0, over all files in the order of their paths) and value. `change` is what a piece adds to the
    state, which is 0 (modulo `modulus`) where a record ends; pieces of a record are joined by the separator. What follows
    the last end of a file is no record, nor are single pieces that are `blank`."""
    spark, here = parts.sparkSession, Window.partitionBy("file", "start").orderBy("seq")
    parts = parts.withColumn("change", change)
    state = lambda c: F.pmod(c, F.lit(modulus)) if modulus else c
    rows = parts.withColumn("after", F.sum("change").over(here)).join(F.broadcast(_before(parts, F.col("change"), "base", True)), ["file", "start"])
    rows = rows.withColumns({"whole": state(F.col("base") + F.col("after") - F.col("change")) == 0, "ends": state(F.col("base") + F.col("after")) == 0})
    if blank is not None:
        rows = rows.filter(~(blank & F.col("whole") & F.col("ends")))
    rows = rows.withColumn("earlier", F.coalesce(F.sum(F.col("ends").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    path = shared.new_folder(spark, "records")
    rows.select("file", "start", "seq", "value", "whole", "ends", "earlier").write.parquet(path)
    rows = spark.read.parquet(path)
    rows = rows.join(F.broadcast(_before(rows, F.col("ends").cast("long"), "first", False)), ["file", "start"]).withColumn("record", F.col("first") + F.col("earlier"))
    alone = F.col("whole") & F.col("ends")
    several = rows.filter(~alone).groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))), lambda x: x["value"]), separator).alias("value"), F.max("ends").alias("ends"))
    # values are null outside their condition, as parsers of later filters may be asked before it
    return rows.filter(alone).select("file", "record", F.when(alone, F.col("value")).alias("value")).unionByName(several.filter("ends").select("file", "record", F.when(F.col("ends"), F.col("value")).alias("value")))


def quotes(value: Column) -> Column:
    """How many double quotes a text has, modulo 2."""
    return F.pmod(F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit(""))), F.lit(2))


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """record, value: the outermost elements `tag` of XML files, each with all that is in it, in the order of the files."""
    parts = pieces(spark, path, f"</{tag}>")
    opened = F.regexp_count("value", F.lit(rf"<{tag}(?=[\s>/])")) - F.regexp_count("value", F.lit(rf"<{tag}(?:\s[^>]*)?/>"))
    whole = joined(parts, opened - 1, f"</{tag}>")
    begun = F.nullif(F.regexp_extract("value", rf"(?s)(<{tag}(?=[\s>]).*)", 1), F.lit(""))
    return whole.select("record", F.concat(begun, F.lit(f"</{tag}>")).alias("value"))


#: a comment, a CDATA section, an instruction or declaration, or a tag with its attributes; text stands between them
_MARKUP = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:"[^"]*"|'[^']*'|[^'">])*>|<(/?)([^\s/>]+)((?:"[^"]*"|'[^']*'|[^'">])*?)(/?)>""", re.S)
_CODE = re.compile(r"""(?:^|\s)code\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&([^;]*;?)")
_XML_SPACE = " \t\r\n"


def _unescaped(text: str) -> str:
    """Text with its five named and all numeric entities replaced; others are an error."""
    for name in _ENTITY.findall(text):
        if not re.fullmatch(r"(?:lt|gt|amp|apos|quot|#\d+|#x[0-9A-Fa-f]+);", name):
            raise ValueError(f"unknown entity &{name}")
    return html.unescape(text)


def strict_entity(text: str, tag: str = "drug") -> tuple[str, str, str, list[str]]:
    """name, description, indication and ATC codes of what stands between two ends of elements `tag`.

    The name is the first text in a `name`; description and indication are the texts, at its own depth, of the first
    such element that has any; codes are those of `atc-code` elements with an end tag. Self-closing elements, comments
    and CDATA do not count, nor does what stands before the first begin of a `tag`.
    """
    inside, depth, name, codes, code = False, 0, None, [], None
    in_name, found, at = False, {"description": [], "indication": []}, {}
    end = 0
    for m in [*_MARKUP.finditer(text), None]:
        said = text[end : m.start() if m else len(text)].strip(_XML_SPACE)
        if "<" in said:
            raise ValueError("broken markup")
        if said and inside:
            said = _unescaped(said)
            if in_name and name is None:
                name = said
            else:
                for kind, own in at.items():
                    if own == depth:
                        found[kind].append(said)
                        break
        if m is None:
            break
        end = m.end()
        closing, element, attributes, empty = m.groups()
        if element is None or empty:
            continue
        if closing:
            if element == "name":
                in_name = False
            elif at.get(element) == depth:
                del at[element]
            elif element == "atc-code":
                codes, code = [*codes, code] if code else codes, None
            depth -= 1
            continue
        depth += 1
        inside = inside or element == tag
        if not inside:
            continue
        if element == "name":
            in_name = in_name or name is None
        elif element in found and element not in at and not found[element]:
            at[element] = depth
        elif element == "atc-code":
            code = next((a or b for a, b in _CODE.findall(attributes)), code)
    return name or "", "".join(found["description"]), "".join(found["indication"]), codes


def strict_entities(ends: DataFrame, tag: str) -> DataFrame:
    """Rows (value, row_id) of pieces that end with an element `tag` as name, description, indication, atc_codes, seq."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [strict_entity(t, tag) for t in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(1)], names=["name", "description", "indication", "atc_codes", "seq"])

    return ends.select("value", "row_id").mapInArrow(parsed, "name string, description string, indication string, atc_codes array<string>, seq long")
