"""Registered queries of the core engine, each with its DuckDB oracle where SQL can express it.

Table-driven queries read whole tables; literal ones run over small fixtures that both engines get
as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..operators import cosines, dedup, match, phrases, sampling, tfidf, vectors
from ..sources import readers, writers
from . import oracles as O
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


class Fixture:
    """Rows for both engines: invented ones and, in `TEXTS`, worked examples of the rules."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        def lit(v) -> str:
            if isinstance(v, list):
                return "CAST([" + ", ".join(map(lit, v)) + "] AS VARCHAR[])"
            return str(v) if isinstance(v, int) else O.q(v)

        return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in self.rows)}) AS v({', '.join(self.names)}))"


RAW = Fixture("row_id bigint, generic string, brand string, category string", [
    (1, "Acetaminophen (oral)", "Zeta®", "Analgesic"), (2, "ACETAMINOPHEN", "zeta", "-"), (3, "Amoxicillin/Clavulanate", "None", "'-'"),
    (4, "Montélukast [obsolete]", "unbranded", "Antiasthma; leukotriene"), (5, "a (b (c) d)", "", ""), (6, "Ācid", "X—Y", " Diuretic™ "),
    (7, "(as sodium)", "Kappa", "Antibiotic"), (8, "  Two\tWords  ", "Brand / Name", "nsaid"), (9, "Amoxicillin", "none", ""),
])
DICTIONARY = Fixture("name_key string, description string, indication string, atc_codes array<string>", [
    ("acetaminophen", "Acetaminophen is an analgesic [A1].", "Used to treat mild pain and fever", ["N02BE01", "N02BE51"]),
    ("amoxicillin", "Amoxicillin is an antibiotic that inhibits bacterial cell wall synthesis in organisms.", "", ["J01CA04"]),
    ("clavulanate potassium", "", "Infection of the middle ear in patients with otitis", []),
    ("montelukast", "Take one tablet, dosage is 10 mg.", "", ["R03DC03"]),
    ("kappa", "Brand-level entry for treatment of a severe skin disease", "", []),
    ("alpha one", "Works by slowing the growth of the cells in the body.", "indicated for the treatment of severe fever", []),
])
PRODUCTS = Fixture("row_id bigint, generic_name string, drug_name string, category string", [
    (1, "acetaminophen", "zeta", "Analgesic"), (2, "amoxicillin / clavulanate", "none", ""), (3, "montelukast", "unbranded", "Antiasthma leukotriene"),
    (4, "a d", "", ""), (5, "cid", "x-y", "Diuretic"), (6, "", "kappa", "Antibiotic"), (7, "alph / amoxicillin", "", ""),
    (8, "alpha / beta", "none", "x"), (9, "clavulanate potassium salt / zinc", "", ""), (10, "Acetaminophén", "kappa", ""), (11, "abc / amoxicillin", "", ""),
])
TEXTS = Fixture("id bigint, text string", list(enumerate([
    "Ibuprofen is a non-steroidal anti-inflammatory drug (NSAID). It is indicated for the treatment of mild to moderate pain, fever, and inflammation...",
    "Used for: Relief of chronic pain in adults with severe disease",
    "Amoxicillin is an antibiotic [A123] that inhibits bacterial cell wall synthesis in susceptible organisms. It is used to treat respiratory tract infections; indicated for otitis media in children.",
    "Used for the treatment of hypertension in adult patients with diabetes.", "Used for the treatment of mild to moderate pain in adult patients with arthritis.",
    "Treats infections caused by susceptible bacteria in patients with pneumonia.", "Treatment of advanced or metastatic breast cancer in combination with chemotherapy.",
    "the the treatment of treatment of asthma", "the treatment of", "", "Works by blocking the reuptake of serotonin in nerve cells. Binds to receptors.",
    "It is an agonist of the beta receptor found in lungs, keep out of reach. Treats asthma attacks quickly; treats asthma attacks quickly.",
    "A statin. It is a statin that exerts its effect by reducing cholesterol production in the liver; used for high cholesterol levels.",
    "Dosage is two capsules. Nothing else is said here about this.", "in patients whose pain persists", "Naproxén—NSAID “quoted” … ≥5  items",
])))
NAMES = Fixture("row_id bigint, generic_name string, drug_name string, description string", [
    (1, "Ibuprofen", "Advil", "nsaid for pain"), (2, " Ibuprofen ", "Unbranded", "nsaid again"), (3, "Asthmol", "NONE", "against asthma"), (4, "Amoxicillin", "none reformulated", " "),
    (5, "IBUPROFEN", "advil", "nsaid, later text"), (6, "Cortisol", "", "a corticosteroid against asthma"), (7, "amoxicillin and more", "Amox", "antibiotic"), (8, "adapalene gel", "Ada", "for skin"),
])

DOC_PHRASES = ("released under the mit license", "the of", "of the", "in the", "de la")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _column(name: str, tab: str, key: str, col: str, fn, sql) -> None:
    register(name, lambda s, d: table(s, d, tab).select(key, fn(F.coalesce(F.col(col), F.lit(""))).alias("cleaned")), f"SELECT {key}, {sql(f'''coalesce({col}, '')''')} AS cleaned FROM {tab}")


def _fixture(name: str, fixture: Fixture, key: str, expr, sql: str) -> None:
    register(name, lambda s, d: fixture.df(s).select(key, expr().alias("result")), f"SELECT {key}, {sql} AS result FROM {fixture.sql} AS f")


# cleaning
_column("clean_ascii_keep", "documents", "doc_id", "text", X.keep_ascii, O.keep)
_column("clean_ascii_fold", "documents", "doc_id", "text", X.fold_ascii, O.fold)
_column("clean_sentence", "documents", "doc_id", "text", X.clean_sentence, O.sentence)
_column("clean_markup", "pages", "page_id", "html", X.clean_sentence, O.sentence)
_column("clean_part_name", "part", "p_partkey", "p_name", X.clean_generic, O.generic)
_column("clean_part_brand", "part", "p_partkey", "p_brand", X.clean_brand, O.brand)
_column("clean_part_type", "part", "p_partkey", "p_type", X.clean_category, O.category_name)
_fixture("clean_generic", RAW, "row_id", lambda: F.lower(X.clean_generic(F.col("generic"))), f"lower({O.generic('generic')})")
_fixture("clean_brand", RAW, "row_id", lambda: F.lower(X.clean_brand(F.col("brand"))), f"lower({O.brand('brand')})")
_fixture("clean_category", RAW, "row_id", lambda: X.clean_category(F.col("category")), O.category_name("category"))

# dedup and counts
_SCRAPED = f"(SELECT row_id, lower({O.generic('generic')}) AS generic_name, lower({O.brand('brand')}) AS drug_name, {O.category_name('category')} AS category FROM {RAW.sql} AS f)"


def _raw(spark: SparkSession) -> DataFrame:
    return RAW.df(spark).toDF("row_id", "Generic Name", "Brand Name", "Pharmacologic Category")


register("scrape", lambda s, d: pipeline.scrape(_raw(s)), f"SELECT generic_name, drug_name, arg_min(category, row_id) AS category, min(row_id) AS row_id FROM {_SCRAPED} GROUP BY 1, 2")
register(
    "scrape_stats",
    lambda s, d: dedup.scrape_counts(table(s, d, "orders"), ["o_custkey", "o_orderpriority"]),
    "SELECT count(*) AS total, count(*) - count(DISTINCT (o_custkey, o_orderpriority)) AS duplicates, count(DISTINCT (o_custkey, o_orderpriority)) AS unique_rows FROM orders",
)
_ORDERS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]
for _name, _fn, _dir in (("dedup_first", dedup.first_wins, "ASC"), ("dedup_last", dedup.last_wins, "DESC")):
    register(
        _name,
        lambda s, d, fn=_fn: fn(table(s, d, "orders").select(*_ORDERS), ["o_custkey", "o_orderpriority"], "o_orderkey"),
        f"SELECT {', '.join(_ORDERS)} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey {_dir}) AS r FROM orders) WHERE r = 1",
    )
register(
    "dedup_keyed",
    lambda s, d: dedup.last_value_first_place(table(s, d, "part").select("p_name", "p_brand", "p_partkey"), "p_name", "p_brand", "p_partkey"),
    "SELECT p_name, arg_max(p_brand, p_partkey) AS p_brand, min(p_partkey) AS first_place FROM part WHERE trim(p_brand) <> '' GROUP BY p_name",
)

# match
_K = O.key("generic_name")


def _match_sql(p: str, d: str) -> tuple[str, str, str, str, str]:
    """The four steps and the cascade, over products and a dictionary; steps 3 and 4 meet distinct components."""
    parts = f"(SELECT row_id, pos, trim(component) AS component FROM (SELECT row_id, unnest(string_split(k, ' / ')) AS component, unnest(range(0, len(string_split(k, ' / ')))) AS pos FROM (SELECT row_id, {_K} AS k FROM {p} AS f) WHERE contains(k, ' / ')) WHERE strlen(trim(component)) >= 4)"
    m1 = f"SELECT row_id, name_key FROM (SELECT row_id, {_K} AS name_key FROM {p} AS f) JOIN {d} AS d USING (name_key)"
    m2 = f"SELECT row_id, name_key FROM (SELECT row_id, {O.key('drug_name')} AS name_key FROM {p} AS f) JOIN {d} AS d USING (name_key) WHERE name_key NOT IN ('', 'none')"
    m3 = f"SELECT row_id, CAST(pos AS INT) AS pos, name_key FROM {parts} AS c JOIN {d} AS d ON component = name_key"
    near = f"(SELECT component, name_key FROM (SELECT DISTINCT component FROM {parts}) AS c JOIN {d} AS d ON strlen(name_key) >= 4 AND (contains(component, name_key) OR contains(name_key, component)))"
    m4 = f"SELECT row_id, CAST(pos AS INT) AS pos, name_key FROM {parts} AS c JOIN {near} AS d USING (component)"
    cascade = f"""(SELECT p.*, coalesce(level, 0) AS level, name_key FROM {p} AS p LEFT JOIN (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY least(level, 3), pos, level, -length(name_key), name_key) AS r FROM (
SELECT row_id, name_key, 1 AS level, 0 AS pos FROM ({m1}) UNION ALL SELECT row_id, name_key, 2, 0 FROM ({m2})
UNION ALL SELECT row_id, name_key, 3, pos FROM ({m3}) UNION ALL SELECT row_id, name_key, 4, pos FROM ({m4}))) WHERE r = 1) AS m USING (row_id))"""
    return m1, m2, m3, m4, cascade


_M1, _M2, _M3, _M4, _CASCADE = _match_sql(PRODUCTS.sql, DICTIONARY.sql)
for _name, _fn, _sql in (("match_exact", match.exact, _M1), ("match_brand", match.brand, _M2), ("match_component", match.component_exact, _M3), ("match_substring", match.component_substring, _M4)):
    register(_name, lambda s, d, fn=_fn: fn(PRODUCTS.df(s), DICTIONARY.df(s)), _sql)
register("match_cascade", lambda s, d: match.cascade(PRODUCTS.df(s), DICTIONARY.df(s)), f"SELECT row_id, generic_name, drug_name, category, level, name_key FROM {_CASCADE}")


# the same at size: products of part's names, some combined, against words of all documents and part's names
def _listed(s: SparkSession, d: str) -> DataFrame:
    name, kind = F.col("p_name"), F.pmod("p_partkey", F.lit(4))
    swapped = F.concat(F.substring_index(name, " ", -1), F.lit(" / "), F.substring_index(name, " ", 1))
    generic = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("x"), name)).when(kind == 2, swapped).otherwise(F.concat(name, F.lit("ed / "), F.substring_index(name, " ", -1)))
    return table(s, d, "part").select(F.col("p_partkey").alias("row_id"), generic.alias("generic_name"), F.lower("p_brand").alias("drug_name"), F.col("p_type").alias("category"))


def _known(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").filter("p_size % 2 = 0").select(F.col("p_name").alias("name_key"))
    brands = table(s, d, "part").filter("p_size % 3 = 0").select(F.lower("p_brand").alias("name_key"))
    said = table(s, d, "documents").select(F.explode(X.words(F.lower(F.coalesce("text", F.lit(""))))).alias("name_key"))
    return names.unionByName(brands).unionByName(said).distinct()


_LISTED = "(SELECT p_partkey AS row_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'x' || p_name WHEN 2 THEN string_split(p_name, ' ')[-1] || ' / ' || string_split(p_name, ' ')[1] ELSE p_name || 'ed / ' || string_split(p_name, ' ')[-1] END AS generic_name, lower(p_brand) AS drug_name, p_type AS category FROM part)"
_KNOWN = f"(SELECT DISTINCT name_key FROM (SELECT p_name AS name_key FROM part WHERE p_size % 2 = 0 UNION ALL SELECT lower(p_brand) FROM part WHERE p_size % 3 = 0 UNION ALL SELECT unnest({O.words("lower(coalesce(text, ''))")}) FROM documents))"
register("match_tables", lambda s, d: match.cascade(_listed(s, d), _known(s, d)), f"SELECT row_id, generic_name, drug_name, category, level, name_key FROM {_match_sql(_LISTED, _KNOWN)[4]}")
_WHOLE = "CASE WHEN description <> '' THEN description || ' ' ELSE '' END || CASE WHEN indication <> '' THEN 'Used for: ' || indication ELSE '' END"
def _enriched_sql(cascade: str, dictionary: str) -> str:
    return f"""(SELECT row_id, generic_name, drug_name, concat_ws('; ', nullif(lower(category), ''), nullif(entity, '')) AS description, coalesce(array_to_string(atc_codes, '; '), '') AS atc_codes, name_key IS NOT NULL AS matched, entity <> '' AS cleaned
FROM (SELECT c.*, d.atc_codes, coalesce(CASE WHEN d.name_key IS NOT NULL THEN info END, '') AS entity FROM {cascade} AS c LEFT JOIN (SELECT *, {O.information('whole')} AS info FROM (SELECT *, {_WHOLE} AS whole FROM {dictionary} AS x)) AS d USING (name_key)))"""


_ENRICHED = _enriched_sql(_CASCADE, DICTIONARY.sql)


def _enriched(s: SparkSession) -> DataFrame:
    return match.enrich(match.cascade(PRODUCTS.df(s), DICTIONARY.df(s)), DICTIONARY.df(s))


register("enriched_description", lambda s, d: _enriched(s), f"SELECT * FROM {_ENRICHED}")
register("match_stats", lambda s, d: match.match_counts(_enriched(s)), f"SELECT count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (matched AND cleaned) AS cleaned, count(*) FILTER (matched AND NOT cleaned) AS empty, round(count(*) FILTER (matched) / count(*), 6) AS matched_share FROM {_ENRICHED}")
register("atc_join", lambda s, d: DICTIONARY.df(s).select("name_key", F.array_join("atc_codes", "; ").alias("result")), f"SELECT name_key, array_to_string(atc_codes, '; ') AS result FROM {DICTIONARY.sql} AS d")
register(
    "match_tokens",  # words of part names looked up among the words of all documents
    lambda s, d: table(s, d, "part").select(F.explode(X.words(F.col("p_name"))).alias("name_key")).distinct().join(table(s, d, "documents").select(F.explode(F.array_distinct(X.words(F.lower("text")))).alias("name_key")).groupBy("name_key").agg(F.count(F.lit(1)).alias("n_docs")), "name_key", "left"),
    f"SELECT name_key, n_docs FROM (SELECT DISTINCT unnest({O.words('p_name')}) AS name_key FROM part) LEFT JOIN (SELECT name_key, count(*) AS n_docs FROM (SELECT unnest(list_distinct({O.words('lower(text)')})) AS name_key FROM documents) GROUP BY 1) USING (name_key)",
)

# extraction
for _name, _fn, _sql in (("extract_category", X.category, O.category), ("extract_mechanism", X.mechanism, O.mechanism), ("extract_indications", X.indications, O.indications), ("extract_fallback", X.fallback_sentence, O.fallback), ("extract_key_info", X.key_information, O.information)):
    _fixture(_name, TEXTS, "id", lambda fn=_fn: fn(F.col("text")), _sql("text"))
_fixture("is_rejected", TEXTS, "id", lambda: X.is_rejected(F.col("text")), O.any_of("text", C.REJECT))
_fixture("is_relevant", TEXTS, "id", lambda: X.is_relevant(F.col("text")), O.any_of("text", C.RELEVANT))
_DOC_WORDS = ("the", "der", "que")
register(
    "document_fallback",
    lambda s, d: table(s, d, "documents").select("doc_id", X.fallback_sentence(F.col("text"), _DOC_WORDS).alias("result")),
    f"SELECT doc_id, {O.fallback('text', _DOC_WORDS)} AS result FROM documents",
)

# phrases
PHRASE_SIZES, PHRASE_LEAST, PHRASE_TOP, PHRASE_SHOWN = (3, 4, 5), 5, 20, 50
_NAMES_SQL = "(" + " UNION ALL ".join(O.phrase_names("(SELECT source AS name, text FROM documents WHERE coalesce(text, '') <> '')", n)[1:-1] for n in PHRASE_SIZES) + ")"


def _phrase_names(s: SparkSession, d: str) -> DataFrame:
    return phrases.frequent_names(phrases.spread(table(s, d, "documents").select("source", "text")), "source", "text", PHRASE_SIZES, PHRASE_LEAST)


def _ranked(s: SparkSession, d: str, most: int) -> DataFrame:
    return phrases.top_phrases(phrases.dissimilar(_phrase_names(s, d), PHRASE_LEAST), most)


for _n in PHRASE_SIZES:
    register(
        f"ngrams_{_n}",
        lambda s, d, n=_n: table(s, d, "documents").select("doc_id", F.posexplode(X.ngrams(F.coalesce(F.col("text"), F.lit("")), n)).alias("pos", "phrase")),
        f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, array_to_string(w[i:i + {_n - 1}], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_n - 2})) AS i FROM (SELECT doc_id, {O.words("coalesce(text, '')")} AS w FROM documents))",
    )
_OFTEN = f"(SELECT n, phrase, count(*) AS total FROM {_NAMES_SQL} GROUP BY 1, 2 HAVING count(*) >= {PHRASE_LEAST})"
_DISSIMILAR = f"""(WITH k AS (SELECT * FROM {_NAMES_SQL} JOIN {_OFTEN} USING (n, phrase)),
s AS (SELECT e.name AS earlier, l.name AS name FROM (SELECT DISTINCT name FROM k) AS e JOIN (SELECT DISTINCT name FROM k) AS l ON e.name < l.name AND {O.similar('e.name', 'l.name')})
SELECT n, phrase, max(total) AS total, count(*) AS distinct_names FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS e JOIN s ON s.earlier = e.name WHERE e.n = k.n AND e.phrase = k.phrase AND s.name = k.name) GROUP BY 1, 2 HAVING count(*) >= {PHRASE_LEAST})"""


def _top(most: int) -> str:
    return f"(SELECT n, phrase, total, distinct_names, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY distinct_names DESC, total DESC, phrase) AS rank FROM {_DISSIMILAR}) WHERE rank <= {most})"


register("phrase_freq", lambda s, d: phrases.frequent(_phrase_names(s, d), PHRASE_LEAST), f"SELECT n, phrase, total FROM {_OFTEN}")
register("phrase_dissimilar", lambda s, d: phrases.dissimilar(_phrase_names(s, d), PHRASE_LEAST), f"SELECT n, phrase, total, distinct_names FROM {_DISSIMILAR}")
register("phrase_topk", lambda s, d: _ranked(s, d, PHRASE_SHOWN), f"SELECT * FROM {_top(PHRASE_SHOWN)}")
register(
    "phrase_overlap_dedup",
    lambda s, d: phrases.drop_overlaps(_ranked(s, d, PHRASE_TOP)),
    f"""WITH RECURSIVE t AS (SELECT list(phrase ORDER BY n, rank) AS l FROM {_top(PHRASE_TOP)}),
f AS (SELECT l, 1 AS i, CAST([] AS VARCHAR[]) AS k FROM t UNION ALL
SELECT l, i + 1, CASE WHEN len(list_filter(k, lambda q: contains(q, l[i]) OR contains(l[i], q))) > 0 THEN k ELSE list_append(k, l[i]) END FROM f WHERE i <= len(l))
SELECT CAST(p - 1 AS INT) AS pos, k[p] AS phrase FROM (SELECT k, unnest(range(1, len(k) + 1)) AS p FROM f WHERE i = len(l) + 1)""",
)
_fixture_removed = lambda col="text": phrases.remove_phrases(F.col(col))
register("unboil", lambda s, d: TEXTS.df(s).select("id", _fixture_removed().alias("text")), f"SELECT * FROM {O.removed(TEXTS.sql, C.PHRASES)}")
_DOCS_REMOVED = O.removed("(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)", DOC_PHRASES)
_doc_text = lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
register("unboil_fixpoint", lambda s, d: _doc_text(s, d).select("id", phrases.remove_phrases(F.col("text"), DOC_PHRASES).alias("text")), f"SELECT * FROM {_DOCS_REMOVED}")
register(
    "unboil_stats",
    lambda s, d: phrases.removal_counts(_doc_text(s, d).withColumn("after", phrases.remove_phrases(F.col("text"), DOC_PHRASES)), "text", "after"),
    f"SELECT count(*) AS processed, count(*) FILTER (strlen(a.text) < strlen(coalesce(d.text, ''))) AS changed, count(*) FILTER (coalesce(d.text, '') <> '' AND a.text = '') AS emptied FROM documents AS d JOIN {_DOCS_REMOVED} AS a ON a.id = d.doc_id",
)

# names and cohorts
_BRAND = f"CASE WHEN lower({O.strip('drug_name')}) IN ('', 'unbranded', 'none', 'none reformulated') THEN generic_name ELSE drug_name END"
_brand = lambda: X.brand_or_generic(F.col("generic_name"), F.col("drug_name"))
_fixture("brand_fallback", NAMES, "row_id", _brand, _BRAND)
_fixture("unique_key", NAMES, "row_id", lambda: X.unique_key(F.col("generic_name"), _brand()), f"lower({O.strip('generic_name')}) || '|' || lower({O.strip(_BRAND)})")
_fixture("display_name", NAMES, "row_id", lambda: X.display_name(F.col("generic_name"), _brand()), f"generic_name || '/' || {_BRAND}")
for _name, _col, _part, _ in C.COHORTS:
    register(f"cohort_{_name}", lambda s, d, c=_col, p=_part: sampling.cohort(NAMES.df(s), c, p, ["generic_name", "drug_name", "description"]), f"SELECT generic_name, drug_name, description FROM {NAMES.sql} AS f WHERE {_col} LIKE '%{_part}%'")
register("cohort_documents", lambda s, d: sampling.cohort(table(s, d, "documents"), "text", "stupid", ["doc_id", "source", "lang"]), "SELECT doc_id, source, lang FROM documents WHERE text LIKE '%stupid%'")
register("sample_seeded", lambda s, d: sampling.sample(table(s, d, "documents").select("doc_id"), 110, "doc_id"), "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 110")
register("sample_random", lambda s, d: sampling.random_rows(table(s, d, "documents").select("doc_id"), 10).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_different")), "SELECT least(10, count(*)) AS n_rows, least(10, count(*)) AS n_different FROM documents")
_fixture("combined_text", NAMES, "row_id", lambda: X.combined_text(_brand(), F.col("description")), f"{_BRAND} || ' ' || description")
_fixture("display_label", NAMES, "row_id", lambda: X.display_label(F.col("drug_name")), "upper(string_split(drug_name, '_')[1])")
register(
    "display_lookup",  # of repeated keys the last row names the key
    lambda s, d: NAMES.df(s).select(X.unique_key(F.col("generic_name"), _brand()).alias("key"), X.display_name(F.col("generic_name"), _brand()).alias("display"), "row_id").groupBy("key").agg(F.max_by("display", "row_id").alias("display")),
    f"SELECT key, arg_max(display, row_id) AS display FROM (SELECT row_id, lower({O.strip('generic_name')}) || '|' || lower({O.strip(_BRAND)}) AS key, generic_name || '/' || {_BRAND} AS display FROM {NAMES.sql} AS f) GROUP BY key",
)
register(
    "named_rows",
    lambda s, d: pipeline.named(NAMES.df(s).unionByName(s.createDataFrame([(20, " ", "none", "x"), (21, "", "Brand", "y"), (22, "", "", "z")], NAMES.schema)), strict=False).select("row_id", "drug_name"),
    f"SELECT row_id, {_BRAND} AS drug_name FROM {NAMES.sql} AS f UNION ALL SELECT 21, 'Brand'",
)


# vectors
def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def _sims(s: SparkSession, d: str) -> DataFrame:
    return vectors.pairs(_items(s, d), "label", "vec_id", "embedding")


def _cosines(s: SparkSession, d: str) -> cosines.Cosines:
    return cosines.Cosines(_items(s, d), "label", "vec_id", "embedding")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


_SIMS = f"(SELECT a.label AS cohort, a.vec_id AS i, b.vec_id AS j, {O.cosine('a.embedding', 'b.embedding')} AS sim FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id < b.vec_id)"
_STATS = "count(*) AS n_pairs, round(avg(sim), 6) AS mean_sim, round(stddev_pop(sim), 6) AS std_sim, round(min(sim), 6) AS min_sim, round(max(sim), 6) AS max_sim"
_STAT_COLUMNS = ("mean_sim", "std_sim", "min_sim", "max_sim")
_BANDS = f"""(WITH r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round(sim, 9) DESC, i, j) - 1 AS place, count(*) OVER (PARTITION BY cohort) AS total FROM {_SIMS})
SELECT cohort, band, place - start AS place, i, j, sim FROM (SELECT *, unnest(['top', 'middle', 'bottom']) AS band, unnest([0, total // 2, greatest(0, total - 10)]) AS start FROM r) WHERE place >= start AND place < start + 10)"""


register("cosine_pairs", lambda s, d: _cosines(s, d).pairs(6), f"SELECT cohort, i, j, round(sim, 6) AS sim FROM {_SIMS}")
register("cosine_stats", lambda s, d: _rounded(_cosines(s, d).stats(), *_STAT_COLUMNS), f"SELECT cohort, {_STATS} FROM {_SIMS} GROUP BY cohort")
register("cosine_levels", lambda s, d: _rounded(_cosines(s, d).levels(10), "sim"), f"SELECT cohort, band, place, i, j, round(sim, 6) AS sim FROM {_BANDS}")
register("cosine_level_means", lambda s, d: _rounded(vectors.level_means(_cosines(s, d).levels(10)), "mean_sim"), f"SELECT cohort, band, round(avg(sim), 6) AS mean_sim, count(*) AS n_pairs FROM {_BANDS} GROUP BY 1, 2")
# bands of as many pairs as the cohort has items
_ITEM_BANDS = f"""(WITH m AS (SELECT label AS cohort, count(*) AS n FROM embeddings GROUP BY 1),
r AS (SELECT s.*, n, row_number() OVER (PARTITION BY cohort ORDER BY round(sim, 9) DESC, i, j) - 1 AS place, count(*) OVER (PARTITION BY cohort) AS total FROM {_SIMS} AS s JOIN m USING (cohort))
SELECT cohort, band, place - start AS place, i, j, sim FROM (SELECT *, unnest(['top', 'middle', 'bottom']) AS band, unnest([0, total // 2, greatest(0, total - n)]) AS start FROM r) WHERE place >= start AND place < start + n)"""
register("cosine_item_levels", lambda s, d: _rounded(_cosines(s, d).levels(), "sim"), f"SELECT cohort, band, place, i, j, round(sim, 6) AS sim FROM {_ITEM_BANDS}")
register("cosine_item_level_means", lambda s, d: _rounded(vectors.level_means(_cosines(s, d).levels()), "mean_sim"), f"SELECT cohort, band, round(avg(sim), 6) AS mean_sim, count(*) AS n_pairs FROM {_ITEM_BANDS} GROUP BY 1, 2")
register(
    "cosine_range",
    lambda s, d: _rounded(_cosines(s, d).stats(_items(s, d).select(F.col("label").alias("cohort"), vectors.norm(F.col("embedding").cast("array<double>")).alias("size"))).select("cohort", "range_min", "range_max"), "range_min", "range_max"),
    f"SELECT cohort, round(min(sim), 6) AS range_min, round(max(sim), 6) AS range_max FROM (SELECT cohort, sim FROM {_SIMS} UNION ALL SELECT label, CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 THEN 1.0 ELSE 0.0 END FROM embeddings WHERE label IN (SELECT cohort FROM {_SIMS})) GROUP BY cohort",
)
register(
    "cosine_marks",
    lambda s, d: _rounded(vectors.marked(_cosines(s, d).levels()), "sim"),
    f"WITH b AS (SELECT *, count(*) OVER (PARTITION BY cohort, band) AS n FROM {_ITEM_BANDS}) SELECT cohort, band, mark, i, j, round(sim, 6) AS sim FROM (SELECT *, unnest(['top', 'middle', 'bottom']) AS mark, unnest([0, n // 2, n - 1]) AS spot FROM b) WHERE place = spot",
)
_PER_ITEM = f"(SELECT label AS cohort, vec_id AS item, coalesce(a, 0.0) AS avg_similarity FROM embeddings LEFT JOIN (SELECT item, avg(sim) AS a FROM (SELECT i AS item, sim FROM {_SIMS} UNION ALL SELECT j, sim FROM {_SIMS}) GROUP BY item) ON item = vec_id)"
register("cosine_per_item", lambda s, d: _rounded(_cosines(s, d).per_item(), "avg_similarity"), f"SELECT cohort, item, round(avg_similarity, 6) AS avg_similarity FROM {_PER_ITEM}")
register(
    "embedding_lookup",
    lambda s, d: vectors.lookup(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), _items(s, d).withColumn("seq", F.col("vec_id")), "vec_id", "seq").select("vec_id", F.round(vectors.norm(F.col("embedding").cast("array<double>")), 4).alias("size")),
    "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS size FROM benchmark JOIN embeddings ON item_id = vec_id",
)
register("embedding_missing", lambda s, d: vectors.missing(table(s, d, "documents").select(F.col("doc_id").alias("vec_id")), _items(s, d), "vec_id"), "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")


def _encoded(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "benchmark").select(F.lit("description").alias("embedding_type"), F.col("item_id").cast("string").alias("drug_name"), vectors.encode(F.coalesce("text", F.lit("")), vectors.hashing_encoder()).alias("embedding"))
    return rows.select("embedding_type", "drug_name", F.posexplode("embedding").alias("place", "value")).filter("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 4) + 0.0)


_BUCKETS = f"(SELECT item_id, CAST('0x' || substr(h, 1, 2) AS INT) % 64 AS place, sum(CASE WHEN CAST('0x' || substr(h, 3, 2) AS INT) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM (SELECT item_id, md5(w) AS h FROM (SELECT item_id, unnest({O.words("lower(coalesce(text, ''))")}) AS w FROM benchmark)) GROUP BY 1, 2)"
register("encode_store", _encoded, f"SELECT 'description' AS embedding_type, CAST(item_id AS VARCHAR) AS drug_name, CAST(place AS INT) AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 4) AS value FROM {_BUCKETS} WHERE v <> 0")
register("device_choice", lambda s, d: s.createDataFrame([(c, vectors.device(c)) for c in ("npu", "")], "configured string, device string"), "SELECT * FROM (VALUES ('npu', 'npu'), ('', 'cpu')) AS v(configured, device)")

# TF-IDF
_VOCAB = f"(SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM (SELECT unnest(list_distinct({O.tokens('''coalesce(text, '')''')})) AS term FROM documents) GROUP BY term)"
_WEIGHTS = f"(SELECT item, term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS weight FROM (SELECT item, term, tf * idf AS w FROM (SELECT item_id AS item, term, count(*) AS tf FROM (SELECT item_id, unnest({O.tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2) JOIN {_VOCAB} USING (term)))"
_TPAIRS = f"(SELECT 'all' AS cohort, a.item_id AS i, b.item_id AS j, least(1.0, greatest(0.0, coalesce(dot, 0.0))) AS sim FROM benchmark AS a JOIN benchmark AS b ON a.item_id < b.item_id LEFT JOIN (SELECT x.item AS i, y.item AS j, sum(x.weight * y.weight) AS dot FROM w AS x JOIN w AS y ON x.term = y.term AND x.item < y.item GROUP BY 1, 2) ON a.item_id = i AND b.item_id = j)"


def _weights(s: SparkSession, d: str) -> DataFrame:
    return tfidf.weights(table(s, d, "benchmark"), "item_id", "text", tfidf.vocabulary(table(s, d, "documents"), "text"))


def _tpairs(s: SparkSession, d: str) -> DataFrame:
    return tfidf.pairs(table(s, d, "benchmark"), "item_id", _weights(s, d))


register("tfidf_vocab", lambda s, d: _rounded(tfidf.vocabulary(table(s, d, "documents"), "text"), "idf"), f"SELECT term, df, round(idf, 6) AS idf FROM {_VOCAB}")
_SOURCED = lambda s, d: table(s, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("generic_name"), F.col("text").alias("description"))
register(
    "tfidf_training",  # rows without a generic name are not learnt from
    lambda s, d: _rounded(pipeline.fit_tfidf(_SOURCED(s, d)), "idf"),
    f"WITH documents AS (SELECT text FROM main.documents WHERE doc_id % 5 <> 0 AND coalesce(source, '') <> '') SELECT term, df, round(idf, 6) AS idf FROM {_VOCAB}",
)
register("tfidf_weights", lambda s, d: _rounded(_weights(s, d), "weight"), f"SELECT item, term, round(weight, 6) AS weight FROM {_WEIGHTS}")
register("tfidf_pairs", lambda s, d: _rounded(_tpairs(s, d), "sim"), f"WITH w AS {_WEIGHTS} SELECT cohort, i, j, round(sim, 6) AS sim FROM {_TPAIRS}")
register("tfidf_stats", lambda s, d: _rounded(vectors.pair_stats(_tpairs(s, d)), *_STAT_COLUMNS), f"WITH w AS {_WEIGHTS} SELECT cohort, {_STATS} FROM {_TPAIRS} GROUP BY cohort")


def _compare(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "benchmark").select("item_id", F.lit("all").alias("cohort"))
    b = vectors.per_item(items, "cohort", "item_id", _tpairs(s, d)).select(F.lit("all").alias("dataset"), "avg_similarity")
    a = _cosines(s, d).per_item().select(F.lit("all").alias("dataset"), "avg_similarity")
    return _rounded(vectors.compare(a, b), "mean_a", "std_a", "mean_b", "std_b", "difference")


_TITEM = f"(SELECT item_id, coalesce(a, 0.0) AS avg_similarity FROM benchmark LEFT JOIN (SELECT item, avg(sim) AS a FROM (SELECT i AS item, sim FROM {_TPAIRS} UNION ALL SELECT j, sim FROM {_TPAIRS}) GROUP BY item) ON item = item_id)"
register(
    "compare_models",
    _compare,
    f"WITH w AS {_WEIGHTS}, a AS (SELECT avg(avg_similarity) AS m, stddev_samp(avg_similarity) AS s FROM {_PER_ITEM}), b AS (SELECT avg(avg_similarity) AS m, stddev_samp(avg_similarity) AS s FROM {_TITEM}) SELECT 'all' AS dataset, round(a.m, 6) AS mean_a, round(a.s, 6) AS std_a, round(b.m, 6) AS mean_b, round(b.s, 6) AS std_b, round(abs(a.m - b.m), 6) AS difference FROM a, b",
)
register(
    "accuracy",
    lambda s, d: _rounded(vectors.accuracy(table(s, d, "labels").select("doc_id", F.col("quality").alias("predicted")), table(s, d, "labels").select("doc_id", F.col("toxic").alias("actual")), "doc_id"), "accuracy"),
    "SELECT count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels",
)
register(
    "sql_script",
    lambda s, d: writers.sql_lines(table(s, d, "region"), "Region List").select("line"),
    """SELECT 'DROP TABLE IF EXISTS region_list;' AS line UNION ALL SELECT 'CREATE TABLE region_list (r_regionkey TEXT, r_name TEXT);'
UNION ALL SELECT 'INSERT INTO region_list VALUES (''' || r_regionkey || ''', ''' || replace(r_name, '''', '''''') || ''');' FROM region""",
)


_FOLDED = O.fold("coalesce(text, '')")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded documents to ranked phrases that many sources share."""
    docs = phrases.spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", X.fold_ascii(F.coalesce("text", F.lit(""))).alias("text"))
    return phrases.frequent(phrases.frequent_names(docs, "source", "text", (5,), 5), 5)


register(
    "flagship_phrases",
    flagship,
    f"SELECT n, phrase, count(*) AS total FROM {O.phrase_names(f'(SELECT source AS name, {_FOLDED} AS text FROM documents)', 5)} GROUP BY 1, 2 HAVING count(*) >= 5",
)
