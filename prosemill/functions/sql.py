"""The column rules as SQL functions of a session, for `spark.sql`: built-in expressions, so Catalyst sees into them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: rules of one text, and of two; their SQL is that of the expressions they make
ONE: dict[str, tuple[Callable[[Column], Column], str]] = {
    name: (rule, kind)
    for kind, rules in {
        "STRING": {
            "strip_space": X.strip, "squeeze_space": X.squeeze, "keep_ascii": X.keep_ascii, "fold_ascii": X.fold_ascii, "clean_generic": X.clean_generic, "clean_brand": X.clean_brand,
            "clean_category": X.clean_category, "name_key": X.name_key, "clean_sentence": X.clean_sentence, "drop_citations": X.drop_citations, "entity_category": X.category, "entity_mechanism": X.mechanism,
            "dataset_label": X.dataset_label, "display_label": X.display_label, "sql_identifier": X.identifier, "sql_literal": X.sql_literal,
        },
        "BOOLEAN": {"is_rejected": X.is_rejected, "is_relevant": X.is_relevant, "has_brand": X.has_brand},
        "ARRAY<STRING>": {"word_tokens": X.tokens},
    }.items()
    for name, rule in rules.items()
}
TWO: dict[str, Callable[[Column, Column], Column]] = {"brand_or_generic": X.brand_or_generic, "unique_key": X.unique_key, "display_name": X.display_name, "combined_text": X.combined_text}

#: rules whose expressions hold functions of array elements, written in SQL over the others
_SPACES = "r'(?U)\\s+'"
WRITTEN = {
    "text_words(t STRING) RETURNS ARRAY<STRING>": f"filter(split(t, {_SPACES}), w -> w <> '')",
    "entity_sentence(t STRING) RETURNS STRING": (
        "lower(clean_sentence(get(filter(transform(split(t, '[.;]'), s -> {strip}), s -> octet_length(s) > 30 AND octet_length(s) < 300 AND NOT ({rejected}) AND ({relevant})), 0)))"
    ),
    "similar_names(a STRING, b STRING) RETURNS BOOLEAN": (
        "coalesce(get(text_words(lower(a)), 0), '') = coalesce(get(text_words(lower(b)), 0), '') AND coalesce(get(text_words(lower(a)), 0), '') <> '' "
        "OR octet_length(coalesce(get(text_words(lower(a)), 0), '')) >= 4 AND octet_length(coalesce(get(text_words(lower(b)), 0), '')) >= 4 AND (contains(lower(a), lower(b)) OR contains(lower(b), lower(a)))"
    ),
}
#: all runs of n words; the words are bound once, as the only element of an array
NGRAMS = (
    "text_ngrams(t STRING, n INT) RETURNS ARRAY<STRING>",
    "get(transform(array(text_words(t)), w -> CASE WHEN n > 0 AND size(w) >= n THEN transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')) ELSE CAST(array() AS ARRAY<STRING>) END), 0)",
)


@F.udtf(returnType="pos int, ngram string")
class Ngrams:
    """Table function (text, n): place from 0 and run of n words, one row each. In Python; `text_ngrams` with
    `posexplode` over a subquery gives the same rows by built-in functions."""

    def eval(self, text: str, n: int):
        said = re.findall(r"[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text or "")
        for pos in range(len(said) - n + 1 if n and n > 0 else 0):
            yield pos, " ".join(said[pos : pos + n])


def expression(spark: SparkSession, rule: Callable[..., Column], *names: str) -> str:
    """The SQL text of a rule over columns of these names."""
    empty = spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    made = empty.select(rule(*[F.col(n) for n in names]).alias("made"))._jdf.queryExecution().analyzed().expressions().head()
    return made.child().sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the rules temporary SQL functions, under their names after `prefix`; returns the names."""
    made = []

    def create(head: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
        made.append(prefix + head.split("(")[0])

    for name, (rule, kind) in ONE.items():
        create(f"{name}(t STRING) RETURNS {kind}", expression(spark, rule, "t"))
    for name, rule in TWO.items():
        create(f"{name}(a STRING, b STRING) RETURNS STRING", expression(spark, rule, "a", "b"))
    inside = {k: expression(spark, rule, "s") for k, rule in (("strip", X.strip), ("rejected", X.is_rejected), ("relevant", X.is_relevant))}
    for head, body in WRITTEN.items():
        for known in ("text_words", "clean_sentence"):
            body = body.replace(f"{known}(", f"{prefix}{known}(")
        create(head, body.format(**inside) if "{strip}" in body else body)
    create(NGRAMS[0], NGRAMS[1].replace("text_words(", f"{prefix}text_words("))
    spark.udtf.register(f"{prefix}ngrams", Ngrams)
    return [*made, f"{prefix}ngrams"]
