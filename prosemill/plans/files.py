"""Registered queries that go through files: each writes a table in the shared folder and reads it again."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import phrases, vectors
from ..sources import readers, shared, writers
from . import oracles as O
from . import pipeline
from . import queries as Q
from .queries import register, table


def _saved(s: SparkSession, df: DataFrame, order: str) -> str:
    path = shared.new_folder(s, "csv")
    writers.csv(df, path, order)
    return path


def _product_list(s: SparkSession, d: str) -> str:
    part = table(s, d, "part").select(F.col("p_name").alias("Generic Name"), F.col("p_brand").alias("Brand Name"), F.col("p_type").alias("Pharmacologic Category"), F.col("p_size").alias("Other"), "p_partkey")
    return _saved(s, part, "p_partkey")


def _plain(df: DataFrame) -> DataFrame:
    """Published headers as plain column names."""
    return df.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in df.columns])


_PLACE = "row_number() OVER (ORDER BY p_partkey) - 1 AS row_id"
register("read_products", lambda s, d: _plain(readers.raw_products(s, _product_list(s, d))), f"SELECT p_name AS generic_name, p_brand AS brand_name, p_type AS pharmacologic_category, {_PLACE} FROM part")


def _scraped(s: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(s, "scraped")
    writers.stage(pipeline.scrape(readers.raw_products(s, _product_list(s, d))), path, "row_id")
    return _plain(readers.scraped(s, path))


_CLEAN_PARTS = f"(SELECT p_partkey, lower({O.generic('p_name')}) AS generic_name, lower({O.brand('p_brand')}) AS drug_name, {O.category_name('p_type')} AS category FROM part)"
register("scraped_file", _scraped, f"SELECT generic_name, drug_name, arg_min(category, p_partkey) AS pharmacologic_category, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS row_id FROM {_CLEAN_PARTS} GROUP BY 1, 2")


def _enriched_path(s: SparkSession) -> str:
    path = shared.new_folder(s, "enriched")
    writers.stage(Q._enriched(s).select("row_id", "generic_name", "drug_name", "description", "atc_codes"), path, "row_id")
    return path


_PLACED = f"(SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, generic_name, drug_name, description, atc_codes FROM {Q._ENRICHED})"
register("enriched_file", lambda s, d: _plain(readers.enriched(s, _enriched_path(s))), f"SELECT * FROM {_PLACED}")
register("descriptions_file", lambda s, d: _plain(readers.descriptions(s, _enriched_path(s))), f"SELECT row_id, generic_name, description FROM {_PLACED}")


def _boiled(s: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(s, "boiled")
    rows = readers.enriched(s, _enriched_path(s)).toDF("generic_name", "drug_name", "description", "atc_codes", "row_id")
    writers.stage(pipeline.unboil(rows, C.PHRASES), path, "row_id")
    return _plain(readers.boiled(s, path))


_REMOVED = O.removed(f"(SELECT row_id AS id, description AS text FROM {_PLACED})", C.PHRASES)
register("boiled_file", _boiled, f"SELECT row_id, generic_name, drug_name, text AS description, atc_codes FROM {_PLACED} JOIN {_REMOVED} AS r ON id = row_id")


def _missing_values(s: SparkSession, d: str) -> DataFrame:
    """Tokens of missing values, and no column of codes."""
    rows = table(s, d, "part").select(F.col("p_name").alias("Generic Name"), F.when(F.col("p_size") % 5 == 0, "NA").when(F.col("p_size") % 5 == 1, "null").otherwise(F.col("p_brand")).alias("Drug Name"), F.col("p_type").alias("Description"), "p_partkey")
    return _plain(readers.boiled(s, _saved(s, rows, "p_partkey")))


register("boiled_missing_values", _missing_values, f"SELECT p_name AS generic_name, CASE WHEN p_size % 5 < 2 THEN '' ELSE p_brand END AS drug_name, p_type AS description, '' AS atc_codes, {_PLACE} FROM part")
register("cohort_file", lambda s, d: readers.cohort(s, _saved(s, table(s, d, "part").select(F.col("p_name").alias("a"), F.col("p_brand").alias("b"), F.col("p_type").alias("c"), "p_partkey"), "p_partkey"), row_id=True), f"SELECT p_name AS generic_name, p_brand AS drug_name, p_type AS description, {_PLACE} FROM part")


def _accuracy(s: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(s, "truth")
    table(s, d, "labels").orderBy("doc_id").select(F.col("toxic").cast("string")).write.csv(path, header=False)
    said = readers.numbered(s.read.schema("predicted string").csv(_saved(s, table(s, d, "labels").select(F.col("quality").cast("string").alias("predicted"), "doc_id"), "doc_id"), header=True))
    return Q._rounded(vectors.accuracy(said, readers.truth(s, path), "row_id"), "accuracy")


register("truth_file", _accuracy, Q.ORACLES["accuracy"])


def _reports(s: SparkSession, d: str) -> DataFrame:
    """A report of each cohort written by the report writer and all of them read by pattern."""
    folder, work = shared.new_folder(s, "reports"), shared.new_folder(s, "means")
    Q._cosines(s, d).per_item().write.parquet(work)
    means = s.read.parquet(work)
    for (label,) in means.select("cohort").distinct().collect():  # one file a dataset is the format
        writers.report(means.filter(F.col("cohort") == label), f"{folder}/{label}_bert_sims.csv")
    return Q._rounded(readers.reports(s, f"{folder}/*_bert_sims.csv"), "avg_similarity")


register("report_files", _reports, f"SELECT CAST(cohort AS VARCHAR) AS dataset, CAST(item AS VARCHAR) AS item, round(avg_similarity, 6) AS avg_similarity FROM {Q._PER_ITEM}")


def _store(s: SparkSession, d: str, only: str | None = None) -> str:
    path = shared.new_folder(s, "store")
    rows = Q._items(s, d).select(F.when(F.col("label") % 2 == 0, "description").otherwise("atc").alias("embedding_type"), F.concat(F.lit("g"), "vec_id", F.lit("|g"), "vec_id").alias("drug_name"), "embedding")
    writers.embedding_store(rows.filter(F.col("embedding_type") == only) if only else rows, path, "hashing")
    return path


_META = "SELECT {0} AS total_drugs_with_descriptions, {1} AS total_drugs_with_atc, embedding_type, count(*) AS num_drugs, 64 AS embedding_dim, 'hashing' AS model_name FROM (SELECT CASE WHEN label % 2 = 0 THEN 'description' ELSE 'atc' END AS embedding_type FROM embeddings) {2} GROUP BY embedding_type"
register("store_metadata", lambda s, d: readers.store_metadata(s, _store(s, d)).drop("description"), _META.format("(SELECT count(*) FROM embeddings WHERE label % 2 = 0)", "(SELECT count(*) FROM embeddings WHERE label % 2 = 1)", ""))
register("store_metadata_one_kind", lambda s, d: readers.store_metadata(s, _store(s, d, "description")).drop("description"), _META.format("(SELECT count(*) FROM embeddings WHERE label % 2 = 0)", "CAST(0 AS BIGINT)", "WHERE embedding_type = 'description'"))
register(
    "store_vectors",
    lambda s, d: readers.embedding_store(s, _store(s, d), "atc").select("drug_name", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding").cast("array<double>")), 4).alias("size")),
    "SELECT 'g' || vec_id || '|g' || vec_id AS drug_name, CAST(len(embedding) AS INT) AS dim, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS size FROM embeddings WHERE label % 2 = 1",
)


def _phrase_list(s: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(s, "phrases")
    writers.phrases(s.createDataFrame(list(enumerate(C.PHRASES)), "pos int, phrase string"), path)
    listed = [r[0] for r in s.read.parquet(path).orderBy("pos").select("phrase").collect()]  # a top-k report
    return Q.TEXTS.df(s).select("id", phrases.remove_phrases(F.col("text"), listed).alias("text"))


register("phrase_list_file", _phrase_list, Q.ORACLES["unboil"])

_TOML = """
[paths]
products_csv = "data/products.csv"
knowledge_base_xml = "data/base.xml"
output_file = "out/enriched.csv"
[model]
name = "hashing"
device = "npu"
[data]
csv_file = "out/boiled.csv"
[output]
store = "out/store"
"""


def _config(s: SparkSession, d: str) -> DataFrame:
    c = tomllib.loads(_TOML)
    run, emb = pipeline.Config.of(c), pipeline.EmbeddingConfig.of(c)
    return s.createDataFrame([(run.products_csv, run.output, run.unboiled_output, run.scraped_output, emb.model, emb.device, emb.description, emb.atc)], "products string, output string, unboiled string, scraped string, model string, device string, description boolean, atc boolean")


register("config_values", _config, "SELECT 'data/products.csv' AS products, 'out/enriched.csv' AS output, 'artifact/boiled.csv' AS unboiled, 'data/scraped.csv' AS scraped, 'hashing' AS model, 'npu' AS device, true AS description, true AS atc")


# the knowledge base as a file of XML
def _element(key: str, description: str, indication: str, codes: list[str]) -> str:
    inner = "".join(f"<atc-code code='{c}'><level>x</level></atc-code>" for c in codes)
    return f"<drug type='x'><name>{key}</name><other><deep>1</deep></other><description>{description}</description>" + (f"<indication>{indication}</indication>" if indication else "<indication/>") + f"<atc-codes>{inner}</atc-codes></drug>"


_SPECIAL = "".join((
    "<drug><name>Álpha</name><description>First</description><atc-codes><atc-code code='A1'>x</atc-code><atc-code code='A2'/></atc-codes></drug>",
    "<drug><name>Empty</name></drug>", "<drug><description>No name</description></drug>",
    "<drug><name> Alpha </name><name>Beta</name><description/><description>Second</description><indication>one\ntwo</indication></drug>",
))


def _base_path(s: SparkSession) -> str:
    path = shared.new_folder(s, "base")
    text = "<all>" + _SPECIAL + "".join(_element(*r) for r in Q.DICTIONARY.rows) + "</all>"
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _base(s: SparkSession, d: str) -> DataFrame:
    return readers.knowledge_base(s, _base_path(s)).select("name_key", "description", "indication", F.array_join("atc_codes", "; ").alias("atc_codes"))


_BASE_SQL = f"(SELECT name_key, description, indication, atc_codes FROM {Q.DICTIONARY.sql} UNION ALL SELECT 'alpha', 'Second', 'one' || chr(10) || 'two', CAST([] AS VARCHAR[]))"
register("xml_scan", _base, f"SELECT name_key, description, indication, array_to_string(atc_codes, '; ') AS atc_codes FROM {_BASE_SQL}")


# whole runs
def _run(s: SparkSession, d: str) -> DataFrame:
    """Products and knowledge base from files through all stages; what the last one published."""
    out = shared.new_folder(s, "run")
    raw = Q._raw(s).select("row_id", "Generic Name", "Brand Name", "Pharmacologic Category")
    pipeline.run(s, pipeline.Config(_saved(s, raw, "row_id"), _base_path(s), f"{out}/enriched.csv", f"{out}/boiled.csv", f"{out}/scraped.csv"))
    return _plain(readers.enriched(s, f"{out}/boiled.csv"))


_FIRST = f"(SELECT min(row_id) AS row_id, generic_name, drug_name, arg_min(category, row_id) AS category FROM {Q._SCRAPED} GROUP BY generic_name, drug_name)"
_RUN = f"(SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, generic_name, drug_name, description, atc_codes FROM {Q._enriched_sql(Q._match_sql(_FIRST, _BASE_SQL)[4], _BASE_SQL)})"
_RUN_REMOVED = O.removed(f"(SELECT row_id AS id, description AS text FROM {_RUN})", C.PHRASES)
register("run_files", _run, f"SELECT row_id, generic_name, drug_name, text AS description, atc_codes FROM {_RUN} JOIN {_RUN_REMOVED} AS r ON id = row_id")


def _embed(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "benchmark").select(F.concat(F.lit("g"), "item_id").alias("Generic Name"), F.lit("none").alias("Drug Name"), F.regexp_replace("text", r"\s+", " ").alias("Description"), F.when(F.col("item_id") % 3 == 0, "A01").otherwise("").alias("ATC Codes"), "item_id")
    config = pipeline.EmbeddingConfig("hashing", _saved(s, rows, "item_id"), shared.new_folder(s, "store"))
    return pipeline.embed(s, config).drop("description")


register(
    "embedding_run", _embed,
    "SELECT (SELECT count(*) FROM benchmark) AS total_drugs_with_descriptions, (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0) AS total_drugs_with_atc, embedding_type, num_drugs, 64 AS embedding_dim, 'hashing' AS model_name FROM (SELECT 'description' AS embedding_type, count(*) AS num_drugs FROM benchmark UNION ALL SELECT 'atc', count(*) FROM benchmark WHERE item_id % 3 = 0)",
)


def _cohort_of(s: SparkSession, d: str, label: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The items of every label, or of one, as cohorts, each asked for by its key, and a store that lacks every fourth."""
    cohort = Q._items(s, d).select(F.concat(F.lit("g"), "vec_id").alias("generic_name"), F.lit("Unbranded").alias("drug_name"), F.lit("x").alias("description"), F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("dataset"))
    store = Q._items(s, d).filter("vec_id % 4 <> 0").select(F.concat(F.lit("g"), "vec_id", F.lit("|g"), "vec_id").alias("drug_name"), "embedding")
    return cohort if label is None else cohort.filter(F.col("dataset") == str(label)).drop("dataset"), store


_HELD = "WITH embeddings AS (SELECT * REPLACE (CAST(label AS VARCHAR) AS label) FROM main.embeddings WHERE vec_id % 4 <> 0) "
register("evaluation_stats", lambda s, d: Q._rounded(pipeline.evaluate(*_cohort_of(s, d))["stats"], *Q._STAT_COLUMNS, "range_min", "range_max"), f"{_HELD} SELECT cohort, {Q._STATS}, least(round(min(sim), 6), 1.0) AS range_min, 1.0 AS range_max FROM {Q._SIMS} GROUP BY cohort")
register("evaluation_missing", lambda s, d: pipeline.evaluate(*_cohort_of(s, d))["missing"], "SELECT 'g' || vec_id || '|g' || vec_id AS drug_name, CAST(label AS VARCHAR) AS dataset FROM embeddings WHERE vec_id % 4 = 0")
register("evaluation_per_item", lambda s, d: Q._rounded(pipeline.evaluate(*_cohort_of(s, d))["per_item"], "avg_similarity"), f"{_HELD} SELECT cohort, 'g' || item || '/g' || item AS item, round(avg_similarity, 6) AS avg_similarity FROM {Q._PER_ITEM}")
register(
    "evaluation_tfidf",
    lambda s, d: Q._rounded(pipeline.evaluate_tfidf(table(s, d, "benchmark").select(F.lit("g").alias("generic_name"), F.lit("").alias("drug_name"), F.col("text").alias("description"), F.col("item_id").alias("row_id")), table(s, d, "documents").select(F.lit("g").alias("generic_name"), F.col("text").alias("description")), "all")["stats"].drop("range_min", "range_max"), *Q._STAT_COLUMNS),
    Q.ORACLES["tfidf_stats"],
)


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    """A good cohort file, one that is missing, one with a column too many, one that only the second folder has: each has
    its own outcome, and the good ones have reports."""
    folder = shared.new_folder(s, "cohorts")
    cohort, store = _cohort_of(s, d, 3)
    writers.embedding_store(store.withColumn("embedding_type", F.lit("description")), f"{folder}/store", "hashing")
    three = cohort.select("generic_name", "drug_name", "description", "row_id")
    writers.csv(three, f"{folder}/good_a.csv", "row_id")
    writers.csv(three.withColumn("more", F.lit("m")), f"{folder}/wide_a.csv", "row_id")
    writers.csv(three, f"{folder}/data/other_a.csv", "row_id")
    names = ("good_a.csv", "wide_a.csv", "none_a.csv", "other_a.csv")
    paths = [f"{folder}/{n}" if n != "other_a.csv" else n for n in names]
    done = pipeline.evaluate_files(s, paths, f"{folder}/store", f"{folder}/sims", folder=f"{folder}/data")
    return s.createDataFrame([(n, (done[p] or "").split(":")[0], shared.exists(s, f"{folder}/sims/{n.split('_')[0]}_bert_sims.csv")) for n, p in zip(names, paths, strict=True)], "file string, error string, reported boolean")


register("evaluation_files", _evaluated, "SELECT * FROM (VALUES ('good_a.csv', '', true), ('wide_a.csv', 'ValueError', false), ('none_a.csv', 'FileNotFoundError', false), ('other_a.csv', '', true)) AS v(file, error, reported)")


def _guards(s: SparkSession, d: str) -> DataFrame:
    """What a missing file, a missing kind of embeddings and a missing store lead to."""
    store, rows = _store(s, d, "description"), []
    for what, read in (("csv", lambda: readers.csv(s, f"{store}/none.csv")), ("base", lambda: readers.knowledge_base(s, f"{store}/none.xml")), ("kind", lambda: readers.embedding_store(s, store, "atc")), ("store", lambda: readers.embedding_store(s, f"{store}/none")), ("held", lambda: readers.embedding_store(s, store))):
        try:
            read()
            rows.append((what, ""))
        except FileNotFoundError as e:
            rows.append((what, str(e).split(":")[0]))
    return s.createDataFrame(rows, "what string, error string")


register("existence_guards", _guards, "SELECT * FROM (VALUES ('csv', 'CSV file not found'), ('base', 'knowledge base not found'), ('kind', 'embeddings of type atc not found'), ('store', 'embedding store not found'), ('held', '')) AS v(what, error)")
_SAMPLED = (("one", "generic_name", "src1", 110), ("two", "generic_name", "src2", 10), ("three", "description", "the", 150), ("four", "description", "de", 250), ("five", "description", "tion", 100))


def _cohort_sizes(s: SparkSession, d: str) -> DataFrame:
    """Every cohort of the documents, cut to its sample size."""
    rows = table(s, d, "documents").select(F.col("source").alias("generic_name"), F.lit("none").alias("drug_name"), F.col("text").alias("description"), F.col("doc_id").alias("row_id"))
    return pipeline.cohort_rows(rows, _SAMPLED).select(F.col("dataset").alias("name"), "row_id")


register(
    "cohort_samples",
    _cohort_sizes,
    "SELECT name, doc_id AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5(concat_ws('|', '42', coalesce(source, ''), 'none', coalesce(text, ''), doc_id)), source, text, doc_id) AS r FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS k, * FROM documents WHERE {'source' if c == 'generic_name' else 'text'} LIKE '%{p}%'" for n, c, p, k in _SAMPLED)
    + ")) WHERE r <= k",
)


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Both reports of every cohort side by side, as written and read again; odd datasets have one side only."""
    folder = shared.new_folder(s, "sides")
    means = phrases.stored(Q._cosines(s, d).per_item(), "means")
    for (label,) in means.select("cohort").distinct().collect():  # one file a dataset is the format
        for side in ("bert", "tfidf")[: 1 if label % 2 else 2]:
            writers.report(means.filter(F.col("cohort") == label).withColumn("avg_similarity", F.col("avg_similarity") / (2 if side == "tfidf" else 1)), f"{folder}/{side}/d{label}_{side}_sims.csv")
    out = vectors.compare(readers.reports(s, f"{folder}/bert/*_sims.csv"), readers.reports(s, f"{folder}/tfidf/*_sims.csv"))
    return Q._rounded(out, "mean_a", "std_a", "mean_b", "std_b", "difference")


_SIDE = f"(SELECT 'd' || cohort AS dataset, avg(avg_similarity) AS m, stddev_samp(avg_similarity) AS s FROM {Q._PER_ITEM} GROUP BY 1)"
register("compare_files", _compared, f"SELECT dataset, round(m, 6) AS mean_a, round(s, 6) AS std_a, CASE WHEN CAST(substr(dataset, 2) AS INT) % 2 = 0 THEN round(m / 2, 6) END AS mean_b, CASE WHEN CAST(substr(dataset, 2) AS INT) % 2 = 0 THEN round(s / 2, 6) END AS std_b, CASE WHEN CAST(substr(dataset, 2) AS INT) % 2 = 0 THEN round(m / 2, 6) END AS difference FROM {_SIDE}")
