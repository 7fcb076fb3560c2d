"""Text cleaning, extraction and predicates as Column -> Column, all built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

SPACES = r"(?U)\s+"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it stands in it: as the only element of an array."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, SPACES, " "))


def keep_ascii(c: Column) -> Column:
    """Keep ASCII letters, digits, white space and - / , . and map listed letters with their case."""
    return F.regexp_replace(F.translate(c, C.KEEP_FROM, C.KEEP_TO), r"[^A-Za-z0-9 \t\n\f\r/,.\-]", "")


def clean_generic(c: Column) -> Column:
    """Without bracketed parts, slashes spaced, kept characters only, one space between words."""
    c = F.regexp_replace(strip(c), r"(?U)\s*\([^)]*\)", "")
    c = F.regexp_replace(c, r"(?U)\s*\[[^\]]*\]", "")
    return squeeze(keep_ascii(F.replace(c, F.lit("/"), F.lit(" / "))))


def clean_brand(c: Column) -> Column:
    return squeeze(keep_ascii(strip(c)))


def clean_category(c: Column) -> Column:
    c = strip(c)
    return F.when(c.isin(*C.EMPTY_CATEGORY), F.lit("")).otherwise(keep_ascii(c))


def fold_ascii(c: Column) -> Column:
    """Letters to lower-case base letters where they carry marks, other non-ASCII to spaces."""
    return squeeze(F.regexp_replace(F.translate(c, C.FOLD_FROM, C.FOLD_TO), r"[^\x00-\x7F]", " "))


def name_key(c: Column) -> Column:
    """The key under which names are looked up."""
    return F.lower(fold_ascii(strip(c)))


def clean_sentence(c: Column) -> Column:
    c = F.regexp_replace(fold_ascii(c), r"\[([^\]]+)\]", "")
    c = F.replace(F.replace(c, F.lit("&#13;"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.btrim(squeeze(c), F.lit(",; "))


def drop_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[A-Z0-9]+\]", "")


def any_of(c: Column, parts: Sequence[str]) -> Column:
    """Whether the lowered text contains any part. One pattern for all, as a text that is worked out would be so for each part."""
    low = F.lower(c)
    return low.rlike("|".join(map(re.escape, parts))) if parts else F.lit(False)


def is_rejected(c: Column, parts: Sequence[str] = C.REJECT) -> Column:
    return any_of(c, parts)


def is_relevant(c: Column, parts: Sequence[str] = C.RELEVANT) -> Column:
    return any_of(c, parts)


def _ci(pattern: str) -> str:
    return "(?iu)" + pattern


def category(c: Column, pattern: str = C.CATEGORY) -> Column:
    """The first class named after "is a", lowered; null if none is."""
    found = F.lower(F.regexp_extract(c, _ci(pattern), 1))
    return F.when(found != "", found)


def _accepted(c: Column, least: int) -> Column:
    return (F.octet_length(c) > least) & ~is_rejected(c)


def mechanism(c: Column, patterns: Sequence[str] = C.MECHANISMS) -> Column:
    """Of the patterns' first matches the first accepted one, cleaned and lowered; else null."""
    tried = []
    for p in patterns:
        got = strip(F.regexp_extract(c, _ci(p), 1))
        tried.append(F.when(_accepted(got, 20), F.lower(clean_sentence(got))))
    return F.coalesce(*tried)


def indications(c: Column, patterns: Sequence[str] = C.INDICATIONS, most: int = 3) -> Column:
    """The first distinct accepted matches, pattern by pattern, joined; null if there is none."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(_ci(p)), F.lit(1)) for p in patterns])
    good = F.filter(F.transform(found, strip), lambda x: _accepted(x, 10))
    clean = F.slice(F.array_distinct(F.transform(good, lambda x: F.lower(clean_sentence(x)))), 1, most)
    return F.when(F.size(clean) > 0, F.array_join(clean, "; "))


def fallback_sentence(c: Column, relevant: Sequence[str] = C.RELEVANT) -> Column:
    """The first relevant, not rejected sentence of 31 to 299 bytes, cleaned and lowered; else null."""
    parts = F.filter(F.transform(F.split(c, "[.;]"), strip), lambda x: (F.octet_length(x) > 30) & (F.octet_length(x) < 300) & ~is_rejected(x) & is_relevant(x, relevant))
    return F.lower(clean_sentence(F.get(parts, F.lit(0))))


def key_information(c: Column) -> Column:
    """Category, mechanism and indications, or else the fallback sentence."""

    def told(t: Column) -> Column:
        parts = F.array_compact(F.array(category(t), mechanism(t), indications(t)))
        return bound(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, ". ")).otherwise(F.coalesce(fallback_sentence(t), F.lit(""))))

    return bound(drop_citations(c), told)


def entity_text(description: Column, indication: Column) -> Column:
    """Key information of an entity's description and indication."""
    whole = F.concat(F.when(description != "", F.concat(description, F.lit(" "))).otherwise(""), F.when(indication != "", F.concat(F.lit("Used for: "), indication)).otherwise(""))
    return key_information(whole)


def enriched_description(category_text: Column, entity: Column) -> Column:
    return F.concat_ws("; ", F.nullif(F.lower(category_text), F.lit("")), F.nullif(entity, F.lit("")))


def words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def ngrams(c: Column, n: int) -> Column:
    """All runs of n words, joined by a space; none if there are fewer words."""
    w = words(c)
    count = F.greatest(F.size(w) - n + 1, F.lit(0))
    # n shifted copies side by side; a lambda over positions would split the text again for each
    shifted = F.arrays_zip(*[F.slice(w, i + 1, count).alias(f"w{i}") for i in range(n)])
    return F.transform(shifted, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(n)]))


def similar_names(a: Column, b: Column) -> Column:
    """Same first word, or long first words and one name contains the other."""
    a, b = F.lower(a), F.lower(b)
    fa, fb = F.coalesce(F.get(words(a), F.lit(0)), F.lit("")), F.coalesce(F.get(words(b), F.lit(0)), F.lit(""))
    return ((fa == fb) & (fa != "")) | ((F.octet_length(fa) >= 4) & (F.octet_length(fb) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def has_brand(drug: Column) -> Column:
    return ~F.lower(strip(drug)).isin(*C.NO_BRAND)


def brand_or_generic(generic: Column, drug: Column) -> Column:
    return F.when(has_brand(drug), drug).otherwise(generic)


def unique_key(generic: Column, drug: Column) -> Column:
    return F.concat_ws("|", F.lower(strip(generic)), F.lower(strip(drug)))


def display_name(generic: Column, drug: Column) -> Column:
    return F.concat(generic, F.lit("/"), drug)


def dataset_label(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def display_label(name: Column) -> Column:
    """The label as headings show it."""
    return F.upper(dataset_label(name))


def combined_text(drug: Column, description: Column) -> Column:
    return F.concat(drug, F.lit(" "), description)


def identifier(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"))


def sql_literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def tokens(c: Column) -> Column:
    """Lower-case word tokens, single characters included."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))
