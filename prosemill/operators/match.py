"""Cascading match of product names to an entity dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LEAST = 4  # bytes of components and dictionary names in the component steps
GRAM = 4  # characters of the blocking grams; not more than LEAST
MOST_GRAMS = 1 << 12  # grams that a filter of names lists


def exact(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """row_id, name_key of products whose generic name is in the dictionary."""
    return products.select("row_id", X.name_key(F.col("generic_name")).alias("name_key")).join(dictionary.select("name_key"), "name_key").select("row_id", "name_key")


def brand(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same for brand names other than '' and none."""
    keyed = products.select("row_id", X.name_key(F.col("drug_name")).alias("name_key")).filter(~F.col("name_key").isin("", "none"))
    return keyed.join(dictionary.select("name_key"), "name_key").select("row_id", "name_key")


def components(products: DataFrame) -> DataFrame:
    """row_id, pos, component of combination names."""
    key = X.name_key(F.col("generic_name"))
    parts = products.select("row_id", key.alias("k")).filter(F.contains("k", F.lit(" / "))).select("row_id", F.posexplode(F.split("k", " / ")).alias("pos", "component"))
    return parts.withColumn("component", F.trim("component")).filter(F.octet_length("component") >= LEAST)


def component_exact(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    return components(products).join(dictionary.select(F.col("name_key").alias("component"), "name_key"), "component").select("row_id", "pos", "name_key")


def _grams(c):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(c, i, F.lit(GRAM))))


def component_substring(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs where the component contains the name or the reverse.

    The contained one begins with a gram that the containing one holds, so candidates meet by an
    equi-join on grams and direction instead of a nested loop over both sides. Both directions are
    one join, so the dictionary is read and worked out once. Where the components have few different grams,
    names without any of these are left out before the dictionary is made distinct and shuffled.
    """
    parts = components(products)
    names = dictionary.select("name_key").filter(F.octet_length("name_key") >= LEAST)
    first = lambda c: F.array(F.substring(c, 1, GRAM))
    at = lambda way, grams: F.transform(grams, lambda g: F.struct(F.lit(way).alias("way"), g.alias("g")))
    ways = lambda in_name, in_part: F.explode(F.concat(at("in_name", in_name), at("in_part", in_part))).alias("at")
    asked = parts.select("component").distinct().select("component", ways(first(F.col("component")), _grams(F.col("component")))).select("component", "at.*")
    told = asked.select("way", "g").distinct().limit(MOST_GRAMS + 1).collect()
    if len(told) <= MOST_GRAMS:
        in_name, in_part = ([r.g for r in told if r.way == way] for way in ("in_name", "in_part"))
        names = names.filter(F.exists(_grams(F.col("name_key")), lambda g: g.isin(in_name)) | F.substring("name_key", 1, GRAM).isin(in_part))
    known = names.select("name_key", ways(_grams(F.col("name_key")), first(F.col("name_key")))).select("name_key", "at.*")
    holds = F.when(F.col("way") == "in_name", F.contains("name_key", "component")).otherwise(F.contains("component", "name_key"))
    pairs = asked.join(known, ["way", "g"]).filter(holds).select("component", "name_key").distinct()
    return parts.join(pairs, "component").select("row_id", "pos", "name_key")


def cascade(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every product with level (1 generic, 2 brand, 3 component, 4 substring, 0 none) and name_key.

    Generic before brand before components; components in order, exact before substring within
    one; among substring hits the longest name, then the smallest.
    """
    zero = F.lit(0)
    hits = exact(products, dictionary).select("row_id", "name_key", F.lit(1).alias("level"), zero.alias("pos"))
    hits = hits.unionByName(brand(products, dictionary).select("row_id", "name_key", F.lit(2).alias("level"), zero.alias("pos")))
    open_rows = products.join(hits.select("row_id"), "row_id", "left_anti")  # only misses reach the component steps
    for level, step in ((3, component_exact), (4, component_substring)):
        hits = hits.unionByName(step(open_rows, dictionary).select("row_id", "name_key", F.lit(level).alias("level"), "pos"))
    rank = F.struct(F.when(F.col("level") < 3, F.col("level")).otherwise(3), "pos", "level", -F.length("name_key"), "name_key")
    best = hits.groupBy("row_id").agg(F.min_by(F.struct("level", "name_key"), rank).alias("m"))
    return products.join(best, "row_id", "left").select(*products.columns, F.coalesce("m.level", F.lit(0)).alias("level"), F.col("m.name_key").alias("name_key"))


def enrich(matched: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Products with description and ATC codes of their match; unmatched rows stay. The text of an entity is worked out
    once, before the join, and not for each product and each use."""
    told = dictionary.select("name_key", X.entity_text(F.col("description"), F.col("indication")).alias("entity"), "atc_codes")
    out = matched.join(told, "name_key", "left").withColumn("entity", F.coalesce("entity", F.lit("")))
    entity = F.col("entity")
    return out.select("row_id", "generic_name", "drug_name", X.enriched_description(F.col("category"), entity).alias("description"), F.coalesce(F.array_join("atc_codes", "; "), F.lit("")).alias("atc_codes"), F.col("name_key").isNotNull().alias("matched"), (entity != "").alias("cleaned"))


def match_counts(enriched: DataFrame) -> DataFrame:
    """matched, unmatched, cleaned, empty and the share matched, in one row."""
    out = enriched.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"), F.count_if(F.col("matched") & F.col("cleaned")).alias("cleaned"), F.count_if(F.col("matched") & ~F.col("cleaned")).alias("empty"))
    total = F.col("matched") + F.col("unmatched")
    return out.withColumn("matched_share", F.round(F.when(total > 0, F.col("matched") / total).otherwise(0.0), 6))
