"""Which of many patterns occur in which of many texts: searches and keyword lists that are tables.

A pattern and a text meet on one gram of the pattern: three letters running (fewer in a shorter pattern), of its own the one that
the fewest texts hold. What meets is verified on the text. So a pattern costs in proportion to the texts that hold its
rarest gram, not to all texts, and no pair is formed without a gram in common.

Matching is without case. Defined results: a null or empty pattern occurs nowhere, a null text holds nothing; equal patterns
under several ids are each found; repeated rows of texts give one pair; a key names one text (several texts of a key count as one).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Patterns, and characters of all of them, up to which the patterns' grams are broadcast; beyond, grams are shuffled.
BROADCAST_PATTERNS, BROADCAST_CHARS = 200_000, 8_000_000


def grams(rows: DataFrame, text: str, sizes: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """keep, gram: a row's distinct runs of each of the sizes, in linear time."""
    # one pass of the pattern a size: a match takes no letters, so that runs may overlap
    runs = [F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes]
    return rows.select(*keep, F.explode(F.array_distinct(runs[0] if len(runs) == 1 else F.concat(*runs))).alias("gram"))


def occurrences(texts: DataFrame, patterns: DataFrame, key: str = "key", text: str = "text", pattern_id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """pattern_id, key: each pattern with each text that holds it, once."""
    rows = texts.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).where("t != ''")
    asked = patterns.select(F.col(pattern_id).alias("id"), F.lower(F.col(pattern)).alias("p")).where("p != ''").distinct()
    size = F.least(F.length("p"), F.lit(GRAM))
    n, chars, sizes = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0)), F.collect_set(size)).first()
    none = texts.select(F.col(key).alias(key)).crossJoin(patterns.select(F.col(pattern_id)).limit(0)).select(pattern_id, key).limit(0)
    if not n:
        return none
    small = F.broadcast if n <= BROADCAST_PATTERNS and chars <= BROADCAST_CHARS else lambda df: df
    sizes = sorted(sizes)
    own = grams(asked, "p", sizes, ["id", "p"]).where(F.length("gram") == size)
    held = grams(rows, "t", sizes, ["k"])
    # how many texts hold each gram that a pattern has; a gram that none holds rules its pattern out
    counts = held.join(small(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarity = own.join(small(counts), "gram", "left").groupBy("id", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    anchors = rarity.where("best.n > 0").select("id", "p", F.col("best.gram").alias("gram"))
    met = held.join(small(anchors), "gram").select("k", "id", "p").distinct()
    found = met.join(rows, "k").where(F.contains("t", F.col("p")))
    return found.select(F.col("id").alias(pattern_id), F.col("k").alias(key)).distinct()


def found_in_any(rows: DataFrame, searches: DataFrame, key: str, columns: Sequence[str], search_id: str = "query_id", words: str = "words") -> DataFrame:
    """search_id, key of each search (a text) with the rows that hold it in any of the columns; a blank search finds nothing."""
    texts = rows.select(key, F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("found_text"))
    # a key's columns are several texts: they are told apart while grams are met
    texts = texts.where("found_text is not null").distinct().select(F.struct(key, F.col("found_text")).alias("of"), "found_text")
    return occurrences(texts, searches, "of", "found_text", search_id, words).select(search_id, F.col(f"of.{key}").alias(key)).distinct()


def categories(texts: DataFrame, keywords: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, category of each text that holds any of a category's keywords (keywords: category, keyword)."""
    patterns = keywords.select("category", "keyword").distinct()
    found = occurrences(texts, patterns.select("keyword").distinct(), key, text, "keyword", "keyword")
    return found.join(patterns, "keyword").select(key, "category").distinct()
