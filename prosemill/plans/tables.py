"""Registered queries over the given tables: files read by ranges, published versions, counters of a write, streams,
SQL functions, a fitted model, a bucketed store, and all cohorts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import sql as S
from ..functions import text as X
from ..operators import match, ngram_runs, phrases, tfidf_model, vectors
from ..sources import metrics, publish, readers, shared, writers
from ..streaming import dedup as stream_dedup
from . import files, pipeline
from . import oracles as O
from . import queries as Q
from .queries import register, table

# CSV files whose cells hold line breaks
_text = lambda: F.coalesce("text", F.lit(""))


def _csv_round(s: SparkSession, d: str) -> DataFrame:
    """All documents written as CSV and read again."""
    rows = table(s, d, "documents").select("doc_id", _text().alias("text"), F.concat(F.lit('"'), F.coalesce("lang", F.lit("")), F.lit('",\r\n')).alias("odd"))
    return readers.csv(s, files._saved(s, rows.withColumn("_order", F.col("doc_id")), "_order")).withColumn("doc_id", F.col("doc_id").cast("long"))


register("csv_line_breaks", _csv_round, """SELECT doc_id, coalesce(text, '') AS text, '"' || coalesce(lang, '') || '",' || chr(13) || chr(10) AS odd, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents""")


def _stage_round(s: SparkSession, d: str) -> DataFrame:
    """A stage's own output with line breaks in its descriptions, published and read back."""
    path = shared.new_folder(s, "stage")
    rows = table(s, d, "documents").select(F.concat("source", F.lit("-"), "doc_id").alias("generic_name"), F.col("lang").alias("drug_name"), _text().alias("description"), F.lit("A01; B02").alias("atc_codes"), F.col("doc_id").alias("row_id"))
    writers.stage(rows, path, "row_id")
    return files._plain(readers.enriched(s, path))


register("stage_line_breaks", _stage_round, "SELECT source || '-' || doc_id AS generic_name, lang AS drug_name, coalesce(text, '') AS description, 'A01; B02' AS atc_codes, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")


# XML read by ranges
def _xml(s: SparkSession, d: str) -> str:
    """Documents as entities: two to a name, every third with an entity nested before its indication, codes of both forms."""
    path = shared.new_folder(s, "xml")
    safe = F.replace(F.replace(_text(), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    nested = F.when(F.col("doc_id") % 3 == 0, "<pathway><drug><name>Inner</name></drug></pathway>").otherwise("<drug-interactions><name>other</name></drug-interactions>")
    line = F.concat(
        F.lit("<drug type='x'>\n<name>Entity "), F.expr("doc_id div 2"), F.lit("</name><name>second</name><description>"), safe, F.lit("</description><indication/><atc-codes><atc-code code='A"), F.col("doc_id"),
        F.lit("'>x</atc-code></atc-codes>"), nested, F.lit("<indication>of "), F.col("lang"), F.lit("</indication><atc-code code='Z1'/></drug>"),
    )
    table(s, d, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return path


def _base(s: SparkSession, d: str, strict: bool) -> DataFrame:
    base = readers.knowledge_base(s, _xml(s, d), strict=strict)
    return base.select("name_key", "description", "indication", F.array_join("atc_codes", "; ").alias("atc_codes"))


def _last(description: str, indication: str, more: str) -> str:
    rows = f"SELECT *, {O.strip("coalesce(text, '')")} AS t, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) AS r FROM documents"
    return f"SELECT 'entity ' || (doc_id // 2) AS name_key, {description} AS description, {indication} AS indication, 'A' || doc_id || {more} AS atc_codes FROM ({rows}) WHERE r = 1"


register("xml_elements", lambda s, d: _base(s, d, False), _last("t", "'of ' || lang", "'; Z1'"))
register("xml_strict", lambda s, d: _base(s, d, True), _last("trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'of ' || lang END", "''"))


# outputs published whole, counters of the write's own pass
def _published(s: SparkSession, d: str) -> DataFrame:
    """Products published as they are, then cleaned; what readers see is the second version."""
    path = shared.new_folder(s, "published")
    part = table(s, d, "part").select("p_partkey", "p_name")
    publish.publish_table(part, path)
    publish.publish_table(part.select("p_partkey", X.clean_generic(F.col("p_name")).alias("p_name")), path)
    return publish.read_table(s, path)


register("published_version", _published, f"SELECT p_partkey, {O.generic('p_name')} AS p_name FROM part")

#: all 32 phrases in the documents, some in capitals: two a document in place of frequent words
_P1 = "CASE doc_id % 32 " + " ".join(f"WHEN {i} THEN {O.q(p)}" for i, p in enumerate(C.PHRASES)) + " END"
_P2 = "CASE (doc_id * 7 + 3) % 32 " + " ".join(f"WHEN {i} THEN {O.q(p)}" for i, p in enumerate(C.PHRASES)) + " END"
_PHRASED = f"replace(replace(coalesce(text, ''), ' the ', ' ' || {_P1} || ' '), ' of ', ', ' || upper({_P2}) || '. ')"


def _phrased(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_PHRASED).alias("text"))


_REMOVED_ALL = O.removed(f"(SELECT doc_id AS id, {_PHRASED} AS text FROM documents)", C.PHRASES)
register("unboil_all", lambda s, d: _phrased(s, d).select("id", phrases.remove_phrases(F.col("text")).alias("text")), f"SELECT * FROM {_REMOVED_ALL}")


def _counted(s: SparkSession, d: str) -> DataFrame:
    """Counts of a removal, taken while its output is written."""
    counters = metrics.Counters()
    rows = _phrased(s, d).withColumn("after", phrases.remove_phrases(F.col("text")))
    counters.watch(rows, "removal", **metrics.removal("text", "after")).select("id", "after").write.parquet(shared.new_folder(s, "removed"))
    return s.range(1).select(*[F.lit(v).alias(k) for k, v in counters["removal"].items()])


register("counted_write", _counted, f"SELECT count(*) AS processed, count(*) FILTER (strlen(a.text) < strlen(b.text)) AS changed, count(*) FILTER (b.text <> '' AND a.text = '') AS emptied FROM (SELECT doc_id AS id, {_PHRASED} AS text FROM documents) AS b JOIN {_REMOVED_ALL} AS a USING (id)")


# dedup on streams
_EVENT = ["event_id", "user_id", "event_type", "value", "props"]


def _streamed(s: SparkSession, d: str, last: bool) -> DataFrame:
    """Events in several batches, out of order within them, through keyed state; those without a time stand at the first."""
    folder, keys = shared.new_folder(s, "stream"), ["user_id", "event_type"]
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    least = events.agg(F.coalesce(F.min("ts"), F.timestamp_seconds(F.lit(0))).alias("_least"))  # one row
    events = events.join(F.broadcast(least)).withColumn("ts", F.coalesce("ts", "_least")).drop("_least")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    before = s.conf.get(stream_dedup.STORE[0], None)
    s.conf.set(*stream_dedup.STORE)
    try:
        stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        stream_dedup.drain(stream_dedup.best_rows(stream, keys, "event_id", "ts", last, "3650 days"), f"{folder}/out", f"{folder}/state")
    finally:
        s.conf.set(stream_dedup.STORE[0], before) if before else s.conf.unset(stream_dedup.STORE[0])
    return stream_dedup.latest(s.read.parquet(f"{folder}/out"), keys).select(*_EVENT)


for _name, _way in (("stream_first", "ASC"), ("stream_last", "DESC")):
    register(_name, lambda s, d, last=_way == "DESC": _streamed(s, d, last), f"SELECT {', '.join(_EVENT)} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_way}) AS r FROM events) WHERE r = 1")


# the rules as SQL functions
def _in_sql(s: SparkSession, d: str, text: str, name: str = "documents") -> DataFrame:
    S.register(s, "pm_")
    view = f"pm_{name}"
    table(s, d, name).createOrReplaceTempView(view)
    return s.sql(text.replace("{t}", view))


register(
    "sql_functions",
    lambda s, d: _in_sql(s, d, "SELECT doc_id, pm_name_key(coalesce(text, '')) AS name_key, pm_clean_sentence(coalesce(text, '')) AS sentence, pm_is_rejected(coalesce(text, '')) AS rejected, pm_unique_key(source, lang) AS unique_key FROM {t}"),
    f"SELECT doc_id, {O.key('''coalesce(text, '')''')} AS name_key, {O.sentence('''coalesce(text, '')''')} AS sentence, {O.any_of('''coalesce(text, '')''', C.REJECT)} AS rejected, lower({O.strip('source')}) || '|' || lower({O.strip('lang')}) AS unique_key FROM documents",
)
def _ngrams(s: SparkSession, d: str) -> DataFrame:
    """The words by the SQL function, their 4-grams counted over runs: `text_ngrams` would shuffle each word four times."""
    return ngram_runs.counts(_in_sql(s, d, "SELECT pm_text_words(coalesce(text, '')) AS words FROM {t}"), "words", 4)


register(
    "sql_ngrams",
    _ngrams,
    f"SELECT g, count(*) AS n FROM (SELECT array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {O.words('''coalesce(text, '')''')} AS w FROM documents))) GROUP BY g",
)
register(
    "sql_table_ngrams",
    lambda s, d: _in_sql(s, d, "SELECT item_id, pos, ngram FROM {t}, LATERAL pm_ngrams(text, 3)", "benchmark"),
    f"SELECT item_id, CAST(i - 1 AS INT) AS pos, array_to_string(w[i:i + 2], ' ') AS ngram FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT item_id, {O.words('''coalesce(text, '')''')} AS w FROM benchmark))",
)


# a model fitted in one run and used in another
def _transformed(s: SparkSession, d: str) -> DataFrame:
    path = shared.new_folder(s, "model")
    tfidf_model.TfidfEstimator(textCol="text", itemCol="item_id").fit(table(s, d, "documents")).write().overwrite().save(path)
    return Q._rounded(tfidf_model.TfidfModel.load(path).transform(table(s, d, "benchmark")), "weight")


register("tfidf_model", _transformed, Q.ORACLES["tfidf_weights"])


# a store by buckets
def bucketed(s: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents that have one, from a store in buckets."""
    name = "prosemill_store_" + shared.new_folder(s, "b").rsplit("-", 1)[-1]
    rows = Q._items(s, d).select(F.lit("description").alias("embedding_type"), F.concat(F.lit("g"), "vec_id").alias("drug_name"), "embedding")
    writers.bucketed_store(rows, name, 16)
    asked = table(s, d, "documents").select(F.concat(F.lit("g"), "doc_id").alias("drug_name"))
    return readers.bucketed_vectors(s, name, asked).select("drug_name", F.round(vectors.norm(F.col("embedding").cast("array<double>")), 4).alias("size"))


register("bucket_lookup", bucketed, "SELECT 'g' || vec_id AS drug_name, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS size FROM documents JOIN embeddings ON doc_id = vec_id")

# all cohorts, both models
_SPECS = (("one_a", "generic_name", "src1", 110), ("two_a", "generic_name", "src7", 10), ("three_a", "description", "the", 150), ("four_a", "description", "de", 250), ("five_a", "description", "tion", 100), ("none_a", "description", "no document says this", 5))


def _cohorts(s: SparkSession, d: str) -> DataFrame:
    boiled = table(s, d, "documents").select(F.concat("source", F.lit("-"), "doc_id").alias("generic_name"), F.lit("none").alias("drug_name"), _text().alias("description"), F.col("doc_id").alias("row_id"))
    store = Q._items(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    key = F.concat("source", F.lit("-"), "vec_id")
    out = pipeline.evaluate_cohorts(boiled, store.select(X.unique_key(key, key).alias("drug_name"), "embedding"), _SPECS)
    return Q._rounded(out, "mean_a", "std_a", "mean_b", "std_b", "difference")


_TAGGED = " UNION ALL ".join(f"SELECT '{n.split('_')[0]}' AS dataset, {k} AS k, * FROM named WHERE contains({'g' if c == 'generic_name' else 't'}, '{p}')" for n, c, p, k in _SPECS)
_NAMES = ", ".join(f"('{n.split('_')[0]}')" for n, *_ in _SPECS)


def _means(pairs: str, items: str) -> str:
    """Mean and deviation per dataset of the items' mean similarities."""
    return f"(SELECT dataset, avg(a) AS m, stddev_samp(a) AS s FROM (SELECT dataset, doc_id, coalesce(avg(sim), 0.0) AS a FROM {items} LEFT JOIN (SELECT dataset, i AS doc_id, sim FROM {pairs} UNION ALL SELECT dataset, j, sim FROM {pairs}) USING (dataset, doc_id) GROUP BY 1, 2) GROUP BY 1)"


_COHORTS_SQL = f"""WITH named AS (SELECT doc_id, source || '-' || doc_id AS g, coalesce(text, '') AS t FROM documents),
sampled AS (SELECT dataset, doc_id, t FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || g || '|none|' || t || '|' || doc_id), g, t, doc_id) AS r FROM ({_TAGGED})) WHERE r <= k),
held AS (SELECT dataset, doc_id, embedding FROM sampled JOIN embeddings ON doc_id = vec_id),
bert AS (SELECT a.dataset, a.doc_id AS i, b.doc_id AS j, {O.cosine('a.embedding', 'b.embedding')} AS sim FROM held AS a JOIN held AS b ON a.dataset = b.dataset AND a.doc_id < b.doc_id),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM (SELECT doc_id, unnest({O.tokens('t')}) AS term FROM (SELECT DISTINCT doc_id, t FROM sampled)) JOIN {Q._VOCAB} USING (term) GROUP BY 1, 2)),
sw AS (SELECT dataset, doc_id, term, weight FROM sampled JOIN w USING (doc_id)),
dots AS (SELECT a.dataset, a.doc_id AS i, b.doc_id AS j, sum(a.weight * b.weight) AS dot FROM sw AS a JOIN sw AS b ON a.dataset = b.dataset AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
tf AS (SELECT a.dataset, a.doc_id AS i, b.doc_id AS j, least(1.0, greatest(0.0, coalesce(dot, 0.0))) AS sim FROM sampled AS a JOIN sampled AS b ON a.dataset = b.dataset AND a.doc_id < b.doc_id LEFT JOIN dots AS d ON d.dataset = a.dataset AND i = a.doc_id AND j = b.doc_id)
SELECT n.dataset, coalesce(c.n_rows, 0) AS n_rows, CASE WHEN c.n_rows IS NULL THEN 'no rows' ELSE '' END AS error, round(a.m, 6) AS mean_a, round(a.s, 6) AS std_a, round(b.m, 6) AS mean_b, round(b.s, 6) AS std_b, round(abs(a.m - b.m), 6) AS difference
FROM (VALUES {_NAMES}) AS n(dataset) LEFT JOIN (SELECT dataset, count(*) AS n_rows FROM sampled GROUP BY 1) AS c USING (dataset) LEFT JOIN {_means('bert', 'held')} AS a USING (dataset) LEFT JOIN {_means('tf', 'sampled')} AS b USING (dataset)"""
register("cohort_evaluation", _cohorts, _COHORTS_SQL)


# extraction, enrichment and a whole run over the documents: told as entities, and listed as products by their first words
_FIRST_60, _NEXT_50 = "substr(coalesce(text, ''), 1, 60)", "substr(coalesce(text, ''), 61, 50)"
_TOLD = f"""CASE doc_id % 5 WHEN 0 THEN 'This is an antibiotic [A1]. It works by ' || {_FIRST_60} || '. ' WHEN 1 THEN 'Indicated for the treatment of ' || {_FIRST_60} || '; used to treat ' || {_NEXT_50} || '. '
WHEN 2 THEN 'Treats ' || {_FIRST_60} || '. It inhibits ' || {_NEXT_50} || ' mg. ' WHEN 3 THEN '' ELSE 'Patients need therapy for ' || {_FIRST_60} || '. ' END || coalesce(text, '')"""


def _told(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").withColumn("told", F.expr(_TOLD))


_RULES = {"category": (X.category, O.category), "mechanism": (X.mechanism, O.mechanism), "indications": (X.indications, O.indications), "fallback": (X.fallback_sentence, O.fallback), "information": (X.key_information, O.information)}
_TOLD_SQL = f"(SELECT doc_id, lang, {_TOLD} AS told FROM documents)"
for _name, (_rule, _sql) in _RULES.items():
    register(f"document_{_name}" if _name != "fallback" else "document_told_fallback", lambda s, d, rule=_rule: _told(s, d).select("doc_id", rule(F.col("told")).alias("result")), f"SELECT doc_id, {_sql('told')} AS result FROM {_TOLD_SQL}")
register("document_predicates", lambda s, d: _told(s, d).select("doc_id", X.is_rejected(F.col("told")).alias("rejected"), X.is_relevant(F.col("told")).alias("relevant")), f"SELECT doc_id, {O.any_of('told', C.REJECT)} AS rejected, {O.any_of('told', C.RELEVANT)} AS relevant FROM {_TOLD_SQL}")


def _nth(n: int):
    # split no further than the word needs: one piece may come before the first word, and the rest is a piece
    return F.coalesce(F.get(F.filter(F.split(_text(), X.SPACES, n + 3), lambda w: w != ""), F.lit(n)), F.lit(""))


def _nth_sql(n: int) -> str:
    return f"coalesce(({O.words('''coalesce(text, '')''')})[{n + 1}], '')"


def _doc_products(s: SparkSession, d: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(4))
    name = F.when(kind == 0, _nth(0)).when(kind == 1, F.concat(_nth(1), F.lit(" / "), _nth(0))).when(kind == 2, F.concat(F.lit("zz"), _nth(0), F.lit(" / none"))).otherwise(F.concat(_nth(2), F.lit("(x)")))
    brand = F.when(kind == 3, _nth(0)).otherwise(F.col("lang"))
    return table(s, d, "documents").select(name.alias("Generic Name"), brand.alias("Brand Name"), F.col("source").alias("Pharmacologic Category"), F.col("doc_id").alias("row_id"))


_RAW_DOCS = f"(SELECT doc_id AS row_id, CASE doc_id % 4 WHEN 0 THEN {_nth_sql(0)} WHEN 1 THEN {_nth_sql(1)} || ' / ' || {_nth_sql(0)} WHEN 2 THEN 'zz' || {_nth_sql(0)} || ' / none' ELSE {_nth_sql(2)} || '(x)' END AS generic, CASE doc_id % 4 WHEN 3 THEN {_nth_sql(0)} ELSE lang END AS brand, source AS category FROM documents)"
_CLEAN_DOCS = f"(SELECT row_id, lower({O.generic('generic')}) AS generic_name, lower({O.brand('brand')}) AS drug_name, {O.category_name('category')} AS category FROM {_RAW_DOCS})"
_DOC_LIST = f"(SELECT min(row_id) AS row_id, generic_name, drug_name, arg_min(category, row_id) AS category FROM {_CLEAN_DOCS} GROUP BY 2, 3)"


def _doc_base(s: SparkSession, d: str) -> str:
    """The told documents as an XML knowledge base, each under its first word."""
    path = shared.new_folder(s, "base")
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit("<drug><name>"), safe(_nth(0)), F.lit("</name><description>"), safe(F.col("told")), F.lit("</description><indication>pain in "), F.col("lang"), F.lit("</indication><atc-codes><atc-code code='A"), F.col("doc_id"), F.lit("'>x</atc-code><atc-code code='B1'>x</atc-code></atc-codes></drug>"))
    _told(s, d).repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    return path


_DOC_BASE = f"(SELECT name_key, description, indication, ['A' || doc_id, 'B1'] AS atc_codes FROM (SELECT doc_id, {O.key(_nth_sql(0))} AS name_key, {O.strip(f'({_TOLD})')} AS description, 'pain in ' || lang AS indication FROM documents) WHERE name_key <> '' QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY doc_id DESC) = 1)"
_DOC_ENRICHED = Q._enriched_sql(Q._match_sql("listed", "base")[4], "base")
_DOC_WITH = f"WITH listed AS MATERIALIZED {_DOC_LIST}, base AS MATERIALIZED {_DOC_BASE}, enriched AS MATERIALIZED {_DOC_ENRICHED}"


def _doc_enriched(s: SparkSession, d: str) -> DataFrame:
    products = phrases.stored(pipeline.scrape(_doc_products(s, d)), "products")
    return pipeline.describe(products, phrases.stored(readers.knowledge_base(s, _doc_base(s, d)), "base"))


register("enrich_documents", _doc_enriched, f"{_DOC_WITH} SELECT * FROM enriched")
register(
    "match_stats_documents", lambda s, d: match.match_counts(_doc_enriched(s, d)),
    f"{_DOC_WITH} SELECT count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (matched AND cleaned) AS cleaned, count(*) FILTER (matched AND NOT cleaned) AS empty, round(count(*) FILTER (matched) / count(*), 6) AS matched_share FROM enriched",
)


def _doc_run(s: SparkSession, d: str, counters: metrics.Counters | None = None) -> DataFrame:
    """Products and knowledge base from files through all stages; what the last one published."""
    out = shared.new_folder(s, "run")
    raw = _doc_products(s, d).select("row_id", "Generic Name", "Brand Name", "Pharmacologic Category")
    pipeline.run(s, pipeline.Config(files._saved(s, raw, "row_id"), _doc_base(s, d), f"{out}/enriched.csv", f"{out}/boiled.csv", f"{out}/scraped.csv"), counters)
    return files._plain(readers.enriched(s, f"{out}/boiled.csv"))


_RUN_DOCS = "(SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, generic_name, drug_name, description, atc_codes FROM enriched)"
_RUN_DOCS_REMOVED = O.removed(f"(SELECT row_id AS id, description AS text FROM {_RUN_DOCS})", C.PHRASES)
register("run_documents", _doc_run, f"{_DOC_WITH} SELECT row_id, generic_name, drug_name, text AS description, atc_codes FROM {_RUN_DOCS} JOIN {_RUN_DOCS_REMOVED} AS r ON id = row_id")


def _doc_counts(s: SparkSession, d: str) -> DataFrame:
    """The counters of the whole run, each from the pass that wrote its stage."""
    counters = metrics.Counters()
    _doc_run(s, d, counters)
    return s.range(1).select(*[F.lit(v).alias(k) for k, v in counters.row().items()])


register(
    "run_counters", _doc_counts,
    f"""{_DOC_WITH}, removed AS (SELECT r.text AS after, e.description AS before FROM {_RUN_DOCS} AS e JOIN {_RUN_DOCS_REMOVED} AS r ON r.id = e.row_id)
SELECT (SELECT count(*) FROM documents) AS scraped_total, (SELECT count(*) FROM listed) AS unique_rows, (SELECT count(*) FILTER (matched) FROM enriched) AS matching_matched, (SELECT count(*) FILTER (NOT matched) FROM enriched) AS matching_unmatched,
(SELECT count(*) FILTER (matched AND cleaned) FROM enriched) AS matching_cleaned, (SELECT count(*) FILTER (matched AND NOT cleaned) FROM enriched) AS matching_empty, (SELECT count(*) FROM removed) AS removal_processed,
(SELECT count(*) FILTER (strlen(after) < strlen(before)) FROM removed) AS removal_changed, (SELECT count(*) FILTER (before <> '' AND after = '') FROM removed) AS removal_emptied""",
)


# names: some brands that count as none, some rows without any name
_DRUG = "CASE doc_id % 5 WHEN 0 THEN ' Unbranded ' WHEN 1 THEN 'None reformulated' WHEN 2 THEN '' WHEN 3 THEN lang ELSE upper(source) END"
_GENERIC = "CASE WHEN doc_id % 10 = 2 THEN ' ' ELSE ' ' || source || '-' || (doc_id % 97) END"
_NAMED = f"(SELECT doc_id AS row_id, {_GENERIC} AS generic_name, {_DRUG} AS drug_name, coalesce(text, '') AS description FROM documents)"


def _names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.expr(_GENERIC).alias("generic_name"), F.expr(_DRUG).alias("drug_name"), _text().alias("description"))


_brand = lambda: X.brand_or_generic(F.col("generic_name"), F.col("drug_name"))
register(
    "document_names",
    lambda s, d: _names(s, d).select(
        "row_id", _brand().alias("brand"), X.unique_key(F.col("generic_name"), _brand()).alias("unique_key"), X.display_name(F.col("generic_name"), _brand()).alias("display"),
        F.length(X.combined_text(_brand(), F.col("description"))).alias("combined"), X.display_label(F.concat(X.strip(F.col("generic_name")), F.lit("_x.csv"))).alias("label"),
    ),
    f"SELECT row_id, {Q._BRAND} AS brand, lower({O.strip('generic_name')}) || '|' || lower({O.strip(Q._BRAND)}) AS unique_key, generic_name || '/' || {Q._BRAND} AS display, CAST(length({Q._BRAND} || ' ' || description) AS INT) AS combined, upper(string_split({O.strip('generic_name')} || '_x.csv', '_')[1]) AS label FROM {_NAMED}",
)
register(
    "document_named_rows",  # rows without any name are left out
    lambda s, d: pipeline.named(_names(s, d), strict=False).select("row_id", "drug_name"),
    f"SELECT row_id, {Q._BRAND} AS drug_name FROM {_NAMED} WHERE NOT ({O.strip('generic_name')} = '' AND lower({O.strip('drug_name')}) IN ('', 'unbranded', 'none', 'none reformulated'))",
)
register(
    "document_display_lookup",  # of repeated keys the last row names the key
    lambda s, d: _names(s, d).select(X.unique_key(F.col("generic_name"), _brand()).alias("key"), X.display_name(F.col("generic_name"), _brand()).alias("display"), "row_id").groupBy("key").agg(F.max_by("display", "row_id").alias("display")),
    f"SELECT key, arg_max(display, row_id) AS display FROM (SELECT row_id, lower({O.strip('generic_name')}) || '|' || lower({O.strip(Q._BRAND)}) AS key, generic_name || '/' || {Q._BRAND} AS display FROM {_NAMED}) GROUP BY key",
)
register("scrape_documents", lambda s, d: pipeline.scrape(_doc_products(s, d)), f"SELECT * FROM {_DOC_LIST}")
for _name, _fn, _i in (("exact", match.exact, 0), ("brand", match.brand, 1), ("component", match.component_exact, 2), ("substring", match.component_substring, 3)):
    register(f"match_{_name}_tables", lambda s, d, fn=_fn: fn(Q._listed(s, d), Q._known(s, d)), Q._match_sql(Q._LISTED, Q._KNOWN)[_i])


def _phrase_list(s: SparkSession, d: str) -> DataFrame:
    """The phrases found in the documents, published as data and read again."""
    path = shared.new_folder(s, "phrases")
    writers.phrases(Q.QUERIES["phrase_overlap_dedup"](s, d), path)
    return s.read.parquet(path)


register("phrase_list_documents", _phrase_list, Q.ORACLES["phrase_overlap_dedup"])
