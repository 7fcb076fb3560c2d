"""DuckDB expressions of the column functions, written independently of the Spark ones."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import constants as C

WS = r"[\x09-\x0D\x20\x85\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def keep(x: str) -> str:
    return f"regexp_replace(translate({x}, {q(C.KEEP_FROM)}, {q(C.KEEP_TO)}), '[^A-Za-z0-9 \\t\\n\\f\\r/,.\\-]', '', 'g')"


def generic(x: str) -> str:
    x = rf"regexp_replace({strip(x)}, '{WS}*\([^)]*\)', '', 'g')"
    x = rf"regexp_replace({x}, '{WS}*\[[^\]]*\]', '', 'g')"
    return squeeze(keep(f"replace({x}, '/', ' / ')"))


def brand(x: str) -> str:
    return squeeze(keep(strip(x)))


def category_name(x: str) -> str:
    return f"CASE WHEN {strip(x)} IN ('', '-', '''-''') THEN '' ELSE {keep(strip(x))} END"


def fold(x: str) -> str:
    return squeeze(rf"regexp_replace(translate({x}, {q(C.FOLD_FROM)}, {q(C.FOLD_TO)}), '[^\x00-\x7F]', ' ', 'g')")


def key(x: str) -> str:
    return f"lower({fold(strip(x))})"


def sentence(x: str) -> str:
    x = rf"regexp_replace({fold(x)}, '\[([^\]]+)\]', '', 'g')"
    return f"trim({squeeze(f'''replace(replace({x}, '&#13;', ''), chr(10), ' ')''')}, ',; ')"


def citations(x: str) -> str:
    return rf"regexp_replace({x}, '\[[A-Z0-9]+\]', '', 'g')"


def any_of(x: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {q(p)})" for p in parts) + ")"


def category(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, {q(C.CATEGORY)}, 1, 'i')), '')"


def mechanism(x: str) -> str:
    got = [strip(f"regexp_extract({x}, {q(p)}, 1, 'i')") for p in C.MECHANISMS]
    return "coalesce(" + ", ".join(f"CASE WHEN strlen({g}) > 20 AND NOT {any_of(g, C.REJECT)} THEN lower({sentence(g)}) END" for g in got) + ")"


def indications(x: str) -> str:
    found = " || ".join(f"regexp_extract_all({x}, {q(p)}, 1, 'i')" for p in C.INDICATIONS)
    good = f"list_filter(list_transform({found}, lambda v: {strip('v')}), lambda v: strlen(v) > 10 AND NOT {any_of('v', C.REJECT)})"
    clean = f"list_transform({good}, lambda v: lower({sentence('v')}))"
    first = f"list_filter({clean}, lambda v, i: list_position({clean}, v) = i)"
    return f"nullif(array_to_string(({first})[1:3], '; '), '')"


def fallback(x: str, relevant: Sequence[str] = C.RELEVANT) -> str:
    parts = f"list_transform(string_split_regex({x}, '[.;]'), lambda v: {strip('v')})"
    return f"lower({sentence(f'''(list_filter({parts}, lambda v: strlen(v) > 30 AND strlen(v) < 300 AND NOT {any_of('v', C.REJECT)} AND {any_of('v', relevant)}))[1]''')})"


def information(x: str) -> str:
    """As a subquery, so that long expressions are not nested."""
    return f"(SELECT CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN coalesce({fallback('z')}, '') ELSE concat_ws('. ', a, b, c) END FROM (SELECT z, {category('z')} AS a, {mechanism('z')} AS b, {indications('z')} AS c FROM (SELECT {citations(x)} AS z)))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def phrase_names(source: str, n: int) -> str:
    """Distinct (n, phrase, name) of `source` (name, text)."""
    return f"(SELECT DISTINCT {n} AS n, phrase, name FROM (SELECT name, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT name, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT lower(name) AS name, {words('text')} AS w FROM {source}))) WHERE strlen(phrase) >= 10)"


def similar(a: str, b: str) -> str:
    fa, fb = f"coalesce(({words(f'lower({a})')})[1], '')", f"coalesce(({words(f'lower({b})')})[1], '')"
    return f"(({fa} = {fb} AND {fa} <> '') OR (strlen({fa}) >= 4 AND strlen({fb}) >= 4 AND (contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})))))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def removed(source: str, phrases: Sequence[str]) -> str:
    """id, text of `source` (id, text) after the ordered removal, by recursion over (phrase, occurrence)."""
    cut = "',;:. '"
    listed = "[" + ", ".join(q(p) for p in phrases) + "]"
    left, right = f"rtrim(substr(text, 1, loc - 1), {cut})", f"ltrim(substr(text, loc + length(p)), {cut})"
    return f"""(WITH RECURSIVE step AS (
  SELECT id, text, 1 AS k FROM {source}
  UNION ALL
  SELECT id, CASE WHEN loc = 0 THEN text ELSE {left} || CASE WHEN {left} <> '' AND {right} <> '' THEN ' ' ELSE '' END || {right} END,
         CASE WHEN loc = 0 THEN coalesce((SELECT min(m) FROM unnest(range(k + 1, {len(phrases) + 1})) AS u(m) WHERE contains(lower(text), ({listed})[m])), {len(phrases) + 1}) ELSE k END
  FROM (SELECT id, text, k, ({listed})[k] AS p, instr(lower(text), ({listed})[k]) AS loc FROM step WHERE k <= {len(phrases)}))
SELECT id, trim(regexp_replace(text, '{WS}+', ' ', 'g'), {cut}) AS text FROM step WHERE k = {len(phrases) + 1})"""


def cosine(a: str, b: str) -> str:
    return f"least(1.0, greatest(0.0, coalesce(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 0), 0.0)))"
