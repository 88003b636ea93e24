"""Text functions: Column to Column, all evaluated inside Spark."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V

NO_STRINGS = "array<string>"
#: Where Python's splitlines() splits.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast(NO_STRINGS)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, rf"^{V.SPACE}+|{V.SPACE}+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct_stripped(values: Column) -> Column:
    return F.array_distinct(F.transform(values, strip))


# identifiers and document metadata


def standard_number(text: Column, pattern: str = V.STANDARD_NUMBER) -> Column:
    return first_match(text, pattern)


def standard_numbers(text: Column, pattern: str = V.STANDARD_NUMBER) -> Column:
    """All mentions in the order first seen."""
    return distinct_stripped(all_matches(text, pattern))


def edition(text: Column) -> Column:
    return first_match(text, V.EDITION)


def publication_year(text: Column, number: str = V.STANDARD_NUMBER) -> Column:
    """The first plausible year that doesn't start inside a standard number."""
    return first_match(F.regexp_replace(text, number, " # "), V.YEAR, 1)


def title(text: Column) -> Column:
    """The lines after a title marker, up to five and before an end marker, of the first marker that yields any."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK, -1), strip), lambda x: x != "")

    def after(ls: Column) -> Column:
        blocks = F.transform(ls, lambda x, i: F.when(x.rlike(V.TITLE_MARKER), F.slice(ls, i + 2, F.lit(V.TITLE_LINES))).otherwise(F.array().cast(NO_STRINGS)))
        start = F.struct(F.array().cast(NO_STRINGS).alias("out"), F.lit(False).alias("stop"))
        step = lambda s, x: F.struct(
            F.when(s["stop"] | x.rlike(V.TITLE_END), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"),
            (s["stop"] | x.rlike(V.TITLE_END)).alias("stop")
        )
        joined = F.transform(blocks, lambda b: F.array_join(F.aggregate(b, start, step, lambda s: s["out"]), " "))
        return F.get(F.filter(joined, lambda t: t != ""), F.lit(0))

    return F.get(F.transform(F.array(lines), after), F.lit(0))


# words and grounding


def stem(word: Column) -> Column:
    """The first of ies, es, s cut off where three characters stay; ies gives y."""
    cut = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    long = lambda suffix: F.endswith(word, F.lit(suffix)) & (F.length(word) >= 3 + len(suffix))
    return F.when(long("ies"), F.concat(cut(3), F.lit("y"))).when(long("es"), cut(2)).when(long("s"), cut(1)).otherwise(word)


def content_words(text: Column, stopwords: Sequence[str] = V.STOPWORDS) -> Column:
    words = F.array_except(all_matches(F.lower(text), "[a-z]+"), strings(stopwords))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), stem))


def all_stems(text: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(F.lower(text), "[a-z]+"), stem))


def grounding(words: Column, evidence_stems: Column) -> Column:
    """The share of words that the evidence has; null without words."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, evidence_stems)) / F.size(words))


def off_corpus(words: Column, evidence_stems: Column, n_chunks: Column, least: float = V.LEAST_GROUNDING) -> Column:
    return F.coalesce((n_chunks > 0) & (grounding(words, evidence_stems) < least), F.lit(False))


def contains_any(text: Column, ids: Column) -> Column:
    return F.coalesce(F.exists(ids, lambda i: F.contains(F.lower(text), F.lower(i))), F.lit(False))


# classification


def matching_keys(text: Column, patterns: Mapping[str, str]) -> Column:
    """The keys whose pattern the text matches, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items())))


def query_classes(text: Column, patterns: Mapping[str, str] = V.QUERY_CLASSES, default: str = V.DEFAULT_QUERY_CLASS) -> Column:
    found = matching_keys(text, patterns)
    return F.when(F.size(found) > 0, found).otherwise(strings([default]))


def prioritised_types(classes: Column, types: Mapping[str, Sequence[str]] = V.CLASS_DOCUMENT_TYPES) -> Column:
    """The union of the classes' document types, sorted."""
    by_class = F.create_map(*(x for k, v in types.items() for x in (F.lit(k), strings(v))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(classes, lambda c: F.coalesce(F.element_at(by_class, c), F.array().cast(NO_STRINGS))))))


def first_key(text: Column, patterns: Mapping[str, str]) -> Column:
    """The first key whose pattern the text matches, or null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items()))


def category(text: Column, synonyms: Mapping[str, Sequence[str]] = V.CATEGORY_SYNONYMS) -> Column:
    """A controlled category: itself, or the first with a synonym in the text; else null."""
    low = F.lower(strip(text))
    own = F.when(low.isin(*synonyms), low)
    return F.coalesce(own, *(F.when(contains_any(low, strings(words)), F.lit(k)) for k, words in synonyms.items()))


def intended_use(text: Column) -> Column:
    return first_key(text, V.INTENDED_USES)


def heater_type(text: Column) -> Column:
    return first_key(text, V.HEATER_TYPES)


def requirement_categories(text: Column, keywords: Mapping[str, Sequence[str]] = V.REQUIREMENT_KEYWORDS) -> Column:
    low = F.lower(text)
    any_of = lambda words: F.lit(False) if not words else _or([F.contains(low, F.lit(w)) for w in words])
    return F.array_compact(F.array(*(F.when(any_of(words), F.lit(k)) for k, words in keywords.items())))


def _or(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def states_obligation(text: Column, pattern: str = V.OBLIGATION) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def label(name: Column) -> Column:
    """CONFORMITY_ASSESSMENT as Conformity Assessment."""
    return F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


# other scalars


def search_terms(profile: Mapping[str, Column]) -> Column:
    """Terms in fixed order; combinations only of what is present; distinct and stripped."""
    has = lambda name: F.nullif(strip(profile[name]), F.lit(""))
    # each part alone decides whether there is a pair; the pair is made of the values as they are
    pair = lambda a, b: F.when((F.length(profile[a]) > 0) & (F.length(profile[b]) > 0), strip(F.concat_ws(" ", profile[a], profile[b])))
    terms = [
        *map(has, ("product_name", "product_category", "product_type", "technology")),
        pair("product_type", "product_category"), pair("intended_use", "product_category"), pair("technology", "product_category"),
        *map(has, ("application", "capacity", "electrical_characteristics", "materials", "target_market", "manufacturing_location")),
    ]
    return F.array_distinct(F.array_compact(F.array(*terms)))


def short_title(text: Column, most: int = 60) -> Column:
    text = strip(text)
    cut = F.regexp_replace(F.substr(text, F.lit(1), F.lit(most)), r"(?U)\s+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def hash_embedding(text: Column, dimension: int = 8) -> Column:
    """A deterministic stand-in for a text model: from the sum of code points."""
    total = F.aggregate(
        F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"),
        lambda a, x: a + x
    )
    # the sum is taken once a row, not once a dimension
    return let(total, lambda n: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: ((n + i) % 100) / 100))


def table_block(rows: Column) -> Column:
    """A detected table (array of arrays of cells) as delimited text."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), " | "))
    return F.concat(F.lit("[TABLE]\n"), F.array_join(lines, "\n"), F.lit("\n[/TABLE]"))


def with_table_blocks(text: Column, tables: Column) -> Column:
    """A page's text with each table's flattened text, where it occurs, replaced by its block: the first occurrence, table after table.

    tables: array of structs of flat (the text of the table's region) and rows (arrays of cells). A table without rows, or whose
    text is blank or not there as it is, changes nothing; null tables are none.
    """

    def put(page: Column, t: Column) -> Column:
        flat = strip(t["flat"])
        at = F.position(flat, page)
        there = (F.size(t["rows"]) > 0) & (flat != "") & (at > 0)
        changed = F.concat(F.substr(page, F.lit(1), at - 1), table_block(t["rows"]), F.substr(page, at + F.length(flat)))
        return F.when(F.coalesce(there, F.lit(False)), changed).otherwise(page)

    return F.when(F.size(tables) > 0, F.aggregate(tables, text, put)).otherwise(text)


def is_safe_rephrase(new: Column, old: Column) -> Column:
    return (F.length(new) > 0) & (F.length(new) <= F.length(old) * 1.5 + 40) & ~F.contains(new, F.lit("\n"))


def language_instruction(language: Column, names: Mapping[str, str] = V.LANGUAGE_NAMES) -> Column:
    name = F.coalesce(*(F.when(language == k, F.lit(v)) for k, v in names.items()), language)
    return F.concat(F.lit(V.LANGUAGE_LINE[0]), name, F.lit(" ("), language, F.lit(V.LANGUAGE_LINE[1]))


@cache
def _folding() -> tuple[str, str]:
    """Letters with diacritics, U+00C0 to U+024F and the angstrom sign, and their base letters; what lower() gives has none left."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), 0x212B)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics; a text of one byte a character has none."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *_folding())))


TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    return all_matches(folded(text), TOKEN)


def n_tokens(text: Column) -> Column:
    """As many as tokens() has: folding turns letters into letters."""
    return F.regexp_count(text, F.lit(TOKEN))
