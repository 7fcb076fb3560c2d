"""Secret scans over an incremental blob ledger, in DataFrame operations only.

A blob is the SHA-256 of a text. The ledger holds one row per blob, rule and rule version that was
scanned, with the spans found. A run logs (row, blob), forms the pairs of blob and rule version that
the ledger lacks, scans each missing pair once, appends the result, and joins findings back to every
row with that blob. Which row lends its text for a blob is picked by a fixed-size bit filter, so no
text is shuffled and copies are not scanned again.

Spans come from built-in functions: the matches of a rule and the pieces between them alternate, so
running sums of their lengths are the positions (code points, end exclusive).

Defined results: null text counts as empty and has no spans; rows with equal texts have equal
findings; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitFilter, Scratch, heavy_left_join, table


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str  # leftmost, non-overlapping matches
    group: int = 0  # whose length must be at least `least`
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the scan; the first three are the base kinds, in the order of listing.
NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = Rule("assign", 1, rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16)
HEX = Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32)  # runs are maximal, so the length can be asked for in the pattern
PEM = Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
GITHUB = Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}")
BASE = (ASSIGN, ACCESS, HEX)
RULES = (*BASE, PEM, GITHUB)

_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text that matches it somewhere."""
    pattern = F.lit(rule.pattern)
    whole, asked = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)), F.arrays_zip(whole.alias("m"), asked.alias("g")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("long"), (F.length(m["g"]) >= rule.least).alias("good")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["long"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["good"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(_SPANS))


class BlobLedger:
    """The ledger in a folder; `scan` brings it up to date for a table of texts."""

    def __init__(self, scratch: Scratch, path: str | None = None):
        self.scratch, self.spark = scratch, scratch.spark
        self.path = path or scratch.path("ledger")

    def rows(self) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], f"blob binary, rule string, version int, spans {_SPANS}")
        return self.spark.read.parquet(self.path)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """docs: id, text. Scans the missing pairs; returns the log: rid, id, blob."""
        text = F.coalesce(F.col("text"), F.lit(""))
        hashed = docs.select("id", text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
        log = self.scratch.write(hashed.select("id", "blob").withColumn("rid", F.monotonically_increasing_id()), "paths")
        lender = log.groupBy("blob").agg(F.min("id").alias("id"))
        known = self.rows().groupBy("blob").agg(F.array_distinct(F.collect_list(F.concat_ws("@", "rule", "version"))).alias("had"))
        wanted = F.array(*[F.lit(r.key) for r in rules])
        missing = F.array_sort(F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>"))))
        lender = self.scratch.write(lender.join(known, "blob", "left").select("blob", "id", F.array_join(missing, ",").alias("missing")).filter("missing <> ''"), "unseen")
        for (todo,) in lender.select("missing").distinct().collect():  # subsets of the rules, most often one
            todo_rules = [r for r in rules if r.key in todo.split(",")]
            mark = F.concat(F.col("blob"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
            texts = BitFilter(lender.filter(F.col("missing") == todo), mark).keep(hashed, mark)
            found = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")) for r in todo_rules])
            rows = texts.select("blob", F.explode(found).alias("f")).select("blob", "f.*")
            # a text that the filter lets through twice gives the same row twice; one that it lets through
            # though the ledger has it gives a row again, which readers of the ledger take as a set
            rows = rows.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans"))
            rows.write.mode("append").option("compression", "zstd").parquet(self.path)
        return log


def secret_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, spans (array of start, kind number, kind, end, in order)."""
    scratch = Scratch(spark)
    book = BlobLedger(scratch, ledger)
    log = book.scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    number = order[F.concat_ws("@", "rule", "version")]
    flat = book.rows().filter(F.size("spans") > 0).withColumn("kind", number).filter("kind is not null")
    flat = flat.select("blob", F.explode("spans").alias("s"), "kind", "rule").select("blob", F.struct(F.col("s.start"), F.col("kind"), F.col("rule"), F.col("s.end")).alias("span"))
    sizes = log.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    found = flat.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans")).join(sizes, "blob")
    out = heavy_left_join(log, scratch.write(found, "found"), "blob", "n", log.count())
    return out.select("id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,rule:string,end:int>>")).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(spark, table(spark, sf_dir, "documents"))
    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{BASE[i].name}")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return out.select(F.col("id").alias("doc_id"), *map(count, range(len(BASE))), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    one = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        one.append(
            f"""SELECT doc_id, {i} AS kind, '{r.name}' AS rule, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s, length(m[k]) AS n
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')))
WHERE length(g[k]) >= {r.least}"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(one)}),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(rule || ':' || cast(s AS bigint) || ':' || cast(s + n AS bigint), ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
  string_agg(rule || ':' || cast(s AS bigint) || ':' || cast(s + n AS bigint), ',' ORDER BY s, kind) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
