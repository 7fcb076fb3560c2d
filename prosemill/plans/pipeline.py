"""The stages as DataFrame -> DataFrame functions, and the whole runs over files."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import cosines, dedup, match, phrases, sampling, tfidf, vectors
from ..sources import metrics, readers, shared, writers


@dataclass(frozen=True)
class Config:
    """Paths of the cleaning run; cleaned products are written where a path is given. Without `phrases` they are
    detected in the same run."""

    products_csv: str
    knowledge_base_xml: str
    output: str
    unboiled_output: str = "artifact/boiled.csv"
    scraped_output: str | None = None
    phrases: Sequence[str] | None = C.PHRASES

    @classmethod
    def from_toml(cls, path: str) -> Config:
        return cls.of(readers.config(path))

    @classmethod
    def of(cls, c: dict) -> Config:
        paths, defaults = c["paths"], cls.__dataclass_fields__
        return cls(paths["products_csv"], paths["knowledge_base_xml"], paths["output_file"], paths.get("unboiled_output_file", defaults["unboiled_output"].default), c.get("settings", {}).get("scraped_csv", "data/scraped.csv"))


@dataclass(frozen=True)
class EmbeddingConfig:
    """The embedding run: model and device, input, what to embed, the store."""

    model: str
    csv_file: str
    store: str
    device: str = ""
    description: bool = True
    atc: bool = True

    @classmethod
    def from_toml(cls, path: str) -> EmbeddingConfig:
        return cls.of(readers.config(path))

    @classmethod
    def of(cls, c: dict) -> EmbeddingConfig:
        kinds = c.get("embeddings", {})
        return cls(c["model"]["name"], c["data"]["csv_file"], c["output"]["store"], c["model"]["device"], kinds.get("description", True), kinds.get("atc", True))


def scrape(raw: DataFrame) -> DataFrame:
    """Cleaned products (row_id, generic_name, drug_name, category), first of equal names."""
    out = raw.select("row_id", F.lower(X.clean_generic(F.col("Generic Name"))).alias("generic_name"), F.lower(X.clean_brand(F.col("Brand Name"))).alias("drug_name"), X.clean_category(F.col("Pharmacologic Category")).alias("category"))
    return dedup.first_wins(out, ["generic_name", "drug_name"], "row_id")


def describe(products: DataFrame, dictionary: DataFrame) -> DataFrame:
    return match.enrich(match.cascade(products, dictionary), dictionary)


def find_phrases(enriched: DataFrame, least: int = 5, most: int = 20, sizes: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """pos, phrase: a bounded report of at most most x len(sizes) rows."""
    names = phrases.frequent_names(enriched, "generic_name", "description", sizes, least)
    return phrases.drop_overlaps(phrases.top_phrases(phrases.dissimilar(names, least), most))


def unboil(enriched: DataFrame, listed: Sequence[str]) -> DataFrame:
    return enriched.withColumn("description", phrases.remove_phrases(F.col("description"), listed))


def named(rows: DataFrame, strict: bool) -> DataFrame:
    """Rows with drug_name replaced by the generic name where it is none. Rows without any name are an error
    if strict, else they are left out."""
    blank = (X.strip(F.col("generic_name")) == "") & ~X.has_brand(F.col("drug_name"))
    kept = rows.filter(F.when(blank & F.lit(strict), F.raise_error(F.lit("row without a name")).cast("boolean")).otherwise(~blank))
    return kept.withColumn("drug_name", X.brand_or_generic(F.col("generic_name"), F.col("drug_name")))


def embedding_rows(boiled: DataFrame, column: str, kind: str, make: Callable | None = None) -> DataFrame:
    """embedding_type, drug_name (unique key), embedding, for non-blank texts; a row without a name is an error."""
    keyed = named(boiled, strict=True).withColumn("drug_name", X.unique_key(F.col("generic_name"), F.col("drug_name")))
    texts = dedup.last_value_first_place(keyed.select("drug_name", column, "row_id"), "drug_name", column, "row_id")
    return texts.select(F.lit(kind).alias("embedding_type"), "drug_name", vectors.encode(F.col(column), make or vectors.hashing_encoder()).alias("embedding"))


def embed(spark: SparkSession, config: EmbeddingConfig, make: Callable | None = None) -> DataFrame:
    """Boiled CSV to embedding store, by the kinds that are asked for; returns the store's metadata."""
    boiled = readers.boiled(spark, config.csv_file)
    boiled = boiled.select(F.col("Generic Name").alias("generic_name"), F.col("Drug Name").alias("drug_name"), F.col("Description").alias("description"), F.col("ATC Codes").alias("atc_codes"), "row_id")
    make = make or vectors.hashing_encoder(configured=config.device)
    rows = embedding_rows(boiled.limit(0), "description", "description", make)
    for wanted, column, kind in ((config.description, "description", "description"), (config.atc, "atc_codes", "atc")):
        if wanted:
            rows = rows.unionByName(embedding_rows(boiled, column, kind, make))
    writers.embedding_store(rows, config.store, config.model)
    return readers.store_metadata(spark, config.store)


class Reports(Mapping):
    """Reports by name, each made when it is asked for."""

    def __init__(self, **made: Callable[[], DataFrame]):
        self._make, self._made = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._make)

    def __len__(self) -> int:
        return len(self._make)


def reports(items: DataFrame, sims: DataFrame | cosines.Cosines, **more: Callable[[], DataFrame]) -> Reports:
    """Statistics, bands, their marked pairs and per-item means of items (dataset, item, display, size) and their
    pairs, given as rows or as what works them out by blocks; items are named by `display`."""
    names = items.select(F.col("dataset").alias("cohort"), "item", "display")
    sizes = items.select(F.col("dataset").alias("cohort"), "size")
    by_blocks = isinstance(sims, cosines.Cosines)

    def per_item() -> DataFrame:
        means = sims.per_item() if by_blocks else vectors.per_item(items, "dataset", "item", sims)
        return means.join(names, ["cohort", "item"]).select("cohort", F.col("display").alias("item"), "avg_similarity")

    out = Reports(
        pairs=lambda: sims.pairs() if by_blocks else sims, stats=lambda: sims.stats(sizes) if by_blocks else vectors.pair_stats(sims, sizes), levels=lambda: sims.levels() if by_blocks else vectors.levels(sims),
        level_means=lambda: vectors.level_means(out["levels"]), marked=lambda: vectors.named_pairs(vectors.marked(out["levels"]), names), per_item=per_item, **more,
    )
    return out


def _with_rows(df: DataFrame) -> DataFrame:
    """`df` with row_id; rows without are numbered and written, so that each later scan sees the same numbers."""
    if "row_id" in df.columns:
        return df
    return phrases.stored(df.withColumn("row_id", F.monotonically_increasing_id()), "rows")


def _dataset(name: str | None) -> Column:
    return F.col("dataset") if name is None else F.lit(name).alias("dataset")


def evaluate(cohort: DataFrame, store: DataFrame, dataset: str | None = None, strict: bool = False) -> Reports:
    """Reports over a cohort's stored vectors; of repeated keys the last row (row_id) names the key. Rows without any
    name are skipped, or an error if strict. Keys are requested as often as they stand in the cohort. Without a name
    for it, the column `dataset` says which cohort a row is of; a row may stand in several."""
    rows = named(_with_rows(cohort), strict)
    key = X.unique_key(F.col("generic_name"), F.col("drug_name"))
    asked = rows.select("row_id", key.alias("drug_name"), X.display_name(F.col("generic_name"), F.col("drug_name")).alias("display"), _dataset(dataset))
    shown = asked.groupBy("dataset", "drug_name").agg(F.max_by("display", "row_id").alias("display"))
    last = store.groupBy("drug_name").agg(F.max_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    found = asked.drop("display").join(shown, ["dataset", "drug_name"]).join(last, "drug_name").withColumnRenamed("row_id", "item")
    sims = cosines.Cosines(found, "dataset", "item", "embedding")
    found = found.withColumn("size", vectors.norm(F.col("embedding").cast("array<double>")))
    return reports(found, sims, missing=lambda: vectors.missing(asked, store, "drug_name").select("drug_name", "dataset"))


def fit_tfidf(boiled: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The vocabulary of the descriptions of rows that have a generic name; of the terms `among`, if given."""
    return tfidf.vocabulary(boiled.filter(F.coalesce("generic_name", F.lit("")) != ""), "description", among)


def evaluate_tfidf(cohort: DataFrame, corpus: DataFrame, dataset: str | None = None, vocabulary: DataFrame | None = None, strict: bool = True) -> Reports:
    """Reports over the TF-IDF vectors of a cohort; all rows count, a row without any name is an error if strict. The
    vocabulary is that of `corpus`, unless it is given. Without a name for it, the column `dataset` says which cohort a row is of."""
    rows = named(_with_rows(cohort), strict)
    vocabulary = fit_tfidf(corpus) if vocabulary is None else vocabulary
    items = rows.select(F.col("row_id").alias("item"), "description", X.display_name(F.col("generic_name"), F.col("drug_name")).alias("display"), _dataset(dataset))
    weights = tfidf.weights(items.select("item", "description").dropDuplicates(["item"]), "item", "description", vocabulary)
    sims = tfidf.pairs(items, "item", weights, F.col("dataset"))
    sized = items.join(weights.groupBy("item").agg(F.lit(1.0).alias("size")), "item", "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
    return reports(sized, sims)


def cohorts(boiled: DataFrame, specs=C.COHORTS, seed: int = 42) -> dict[str, DataFrame]:
    """The named cohorts, each cut to its sample size; ties of equal names go by all columns."""
    columns = ["generic_name", "drug_name", "description", "row_id"]
    return {name: sampling.sample(sampling.cohort(boiled, column, part, columns), n, columns, seed) for name, column, part, n in specs}


def evaluate_files(spark: SparkSession, paths: Sequence[str], store: str, out: str, kind: str = "description", folder: str = "data") -> dict[str, str | None]:
    """Per cohort file its report under `out`; a path is looked up as it is and then in `folder`. A file that is
    missing or fails is reported and does not stop the others: path -> None or the error."""
    vectors_of = readers.embedding_store(spark, store, kind)
    done: dict[str, str | None] = {}
    for path in paths:
        at = next((p for p in (path, f"{folder}/{path}") if shared.exists(spark, p)), None)
        try:
            if at is None:
                raise FileNotFoundError(f"CSV file not found: {path}")
            dataset = at.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv").split("_")[0]
            rows = evaluate(readers.cohort(spark, at, row_id=True), vectors_of, dataset)
            writers.report(rows["per_item"], f"{out}/{dataset}_bert_sims.csv")
            done[path] = None
        except Exception as e:  # isolation is the contract: the error is returned and printed
            done[path] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
            print(f"{path}: {done[path]}", file=sys.stderr)
    return done


def cohort_rows(boiled: DataFrame, specs=C.COHORTS, seed: int = 42) -> DataFrame:
    """All cohorts in one pass, each cut to its sample size: the rows with `dataset`, once for every cohort they are in."""
    columns = ["generic_name", "drug_name", "description", "row_id"]
    tags = F.filter(F.array(*[F.when(F.col(column).contains(part), F.struct(F.lit(name.split("_")[0]).alias("dataset"), F.lit(n).alias("n"))) for name, column, part, n in specs]), lambda t: t.isNotNull())
    tagged = boiled.select(*columns, F.explode(tags).alias("tag")).select("tag.*", *columns)
    return sampling.sample_each(tagged, "dataset", "n", columns, seed)


def evaluate_cohorts(boiled: DataFrame, store: DataFrame, specs=C.COHORTS, seed: int = 42) -> DataFrame:
    """All cohorts, sampled, under both kinds of vectors, in one plan: a row per dataset with n_rows, means and deviations
    of both reports, their difference, and `error`: 'no rows', 'row without a name' (then without the TF-IDF side) or ''."""
    rows = phrases.stored(cohort_rows(_with_rows(boiled), specs, seed), "cohorts")
    blank = (X.strip(F.coalesce("generic_name", F.lit(""))) == "") & ~X.has_brand(F.coalesce("drug_name", F.lit("")))
    state = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(blank).alias("unnamed"))
    every = boiled.sparkSession.createDataFrame([(name.split("_")[0],) for name, *_ in specs], "dataset string")  # one row a cohort
    state = every.join(state, "dataset", "left").select("dataset", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows").isNull(), "no rows").when(F.col("unnamed") > 0, "row without a name").otherwise("").alias("error"))
    named_only = rows.join(state.filter("error = ''").select("dataset"), "dataset", "left_semi")
    said = phrases.stored(tfidf.terms(rows, "description"), "terms")  # of the samples, so few
    sides = evaluate(rows, store), evaluate_tfidf(named_only, boiled, vocabulary=fit_tfidf(boiled, said), strict=False)
    compared = vectors.compare(*(side["per_item"].select(F.col("cohort").alias("dataset"), "avg_similarity") for side in sides))
    return state.join(compared, "dataset", "left")


def run(spark: SparkSession, config: Config, counters: metrics.Counters | None = None) -> DataFrame:
    """Products and knowledge base to cleaned descriptions; publishes the three outputs under their published column
    names, each whole or not at all, and returns the last. Missing inputs are an error before anything runs. `counters`
    takes the stages' counts, from the passes that write them: scraped, unique, matching, removal."""
    counters = counters or metrics.Counters()
    shared.require(spark, config.products_csv, "product list")
    shared.require(spark, config.knowledge_base_xml, "knowledge base")
    raw = counters.watch(readers.raw_products(spark, config.products_csv), "scraped", total=metrics.rows())
    products = phrases.stored(counters.watch(scrape(raw), "unique", rows=metrics.rows()), "scraped")
    if config.scraped_output:
        writers.stage(products, config.scraped_output, "row_id")
    base = phrases.stored(readers.knowledge_base(spark, config.knowledge_base_xml), "base")  # each step of the cascade reads it
    enriched = counters.watch(describe(products, base), "matching", **metrics.matching()).select("row_id", "generic_name", "drug_name", "description", "atc_codes")
    enriched = phrases.stored(enriched, "enriched")
    writers.stage(enriched, config.output, "row_id")
    listed = config.phrases
    if listed is None:
        listed = [r[0] for r in find_phrases(enriched).orderBy("pos").select("phrase").collect()]  # at most 60
    out = unboil(enriched.withColumn("before", F.col("description")), listed)
    out = phrases.stored(counters.watch(out, "removal", **metrics.removal("before", "description")).drop("before"), "unboiled")
    writers.stage(out, config.unboiled_output, "row_id")
    return out
