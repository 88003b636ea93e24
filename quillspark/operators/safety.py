"""Checks of answer texts against their evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T


def affirms_mandatory(text: Column, words: str = V.MANDATORY_WORDS, negation: str = V.NEGATION_WORDS) -> Column:
    """A sentence has a mandatory word and no negation."""
    return F.exists(F.split(text, "[.!?]", -1), lambda s: s.rlike(words) & ~s.rlike(negation))


def lists_requirements(text: Column) -> Column:
    return text.rlike(V.CHECKLIST_ITEM)


def values_disagree(stated: Column, actual: Column) -> Column:
    said = F.replace(F.lower(T.strip(F.regexp_replace(T.strip(stated), r"^\*+|\*+$", ""))), F.lit("_"), F.lit(" "))
    real = F.replace(F.lower(T.strip(actual)), F.lit("_"), F.lit(" "))
    return F.coalesce((F.length(said) > 0) & (F.length(real) > 0) & ~F.contains(said, real) & ~F.contains(real, said), F.lit(False))


def restates_wrongly(text: Column, profile: Mapping[str, Column]) -> Column:
    """A line 'Label: value' disagrees with the profile's value."""
    pattern = rf"(?i)({'|'.join(V.PROFILE_LABELS)})\s*:\**\s*([^\n]+)"
    pairs = F.arrays_zip(F.transform(T.all_matches(text, pattern, 1), lambda x: F.lower(x)).alias("label"), T.all_matches(text, pattern, 2).alias("value"))
    actual = lambda name: F.coalesce(
        *(F.when(name == k, profile[a]) for k, a in V.PROFILE_LABELS.items() if a in profile), F.lit(None).cast("string")
    )
    return F.exists(pairs, lambda p: values_disagree(p["value"], actual(p["label"])))


def upper_numbers(text: Column, pattern: str = V.STANDARD_NUMBER) -> Column:
    return F.array_distinct(F.transform(T.standard_numbers(text, pattern), F.upper))


def verdict(answers: DataFrame, evidence: DataFrame, profile: Mapping[str, str] | None = None, pattern: str = V.STANDARD_NUMBER) -> DataFrame:
    """answers (answer_id, text, n_requirements, profile columns) with the four checks and is_safe.

    evidence: answer_id, document_name, text. profile: attribute to column name.
    """
    known = evidence.groupBy("answer_id").agg(
        F.array_distinct(
            F.flatten(F.collect_list(F.array_union(upper_numbers(F.col("document_name"), pattern), upper_numbers(F.col("text"), pattern))))
        ).alias("known")
    )
    rows = answers.join(known, "answer_id", "left")
    made_up = F.array_sort(F.array_except(upper_numbers(F.col("text"), pattern), F.coalesce("known", F.array().cast("array<string>"))))
    wrong = restates_wrongly(F.col("text"), {k: F.col(c) for k, c in profile.items()}) if profile else F.lit(False)
    rows = rows.withColumn("fabricated_numbers", made_up).withColumn("mandatory_claim", affirms_mandatory(F.col("text")))
    rows = rows.withColumn(
        "checklist_claim", (F.coalesce("n_requirements", F.lit(0)) == 0) & lists_requirements(F.col("text"))
    ).withColumn("profile_claim", wrong)
    return rows.withColumn(
        "is_safe", (F.size("fabricated_numbers") == 0) & ~F.col("mandatory_claim") & ~F.col("checklist_claim") & ~F.col("profile_claim")
    ).drop("known")


def standard_key(raw: Column) -> Column:
    """The base number; without one the text in upper case, white space collapsed."""
    return F.coalesce(T.first_match(raw, r"\d{2,6}"), F.upper(F.regexp_replace(T.strip(raw), r"(?U)\s+", " ")))


def standard_keys(text: Column) -> Column:
    return F.array_union(F.transform(T.standard_numbers(text), standard_key), T.all_matches(text, V.FILE_STANDARD_NUMBER, 1))


def unverified_numbers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, unverified: numbers whose base number no evidence has, each base in its first spelling, sorted."""
    known = evidence.groupBy("answer_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.array_union(standard_keys(F.col("document_name")), standard_keys(F.col("text")))))).alias("known")
    )
    raws = F.transform(T.all_matches(F.col("text"), V.STANDARD_NUMBER), T.strip)
    rows = answers.join(known, "answer_id", "left").select(
        "answer_id", F.coalesce("known", F.array().cast("array<string>")).alias("known"),
        F.transform(raws, lambda r: F.struct(standard_key(r).alias("key"), F.regexp_replace(r, r"(?U)\s+", " ").alias("raw"))).alias("said")
    )
    new = F.filter("said", lambda s: ~F.array_contains("known", s["key"]))
    first = F.filter(
        F.transform(new, lambda s, i: F.struct(s["key"].alias("key"), s["raw"].alias("raw"), i.alias("i"))),
        lambda s: ~F.exists(F.slice(new, F.lit(1), s["i"]), lambda t: t["key"] == s["key"])
    )
    return rows.select("answer_id", F.array_sort(F.transform(first, lambda s: s["raw"])).alias("unverified"))


def trimmed(text: Column) -> Column:
    """An answer on a question off the corpus, cut where it stops reporting the documents."""
    whole = T.strip(text)
    pieces = F.filter(F.split(whole, rf"(?<=[.!?]){V.SPACE}+|\n+", -1), lambda p: F.length(T.strip(p)) > 0)
    opens = "^(?:" + "|".join(x.replace(".", r"\.") for x in V.SPECULATION_OPENERS) + ")"

    def ends(p: Column, before: Column) -> Column:
        probe = F.regexp_replace(F.lower(T.strip(p)), r"^[*\-•#0123456789. )]+", "")
        item = p.rlike(r"^\s*(?:\d+[.)]|[-*•])\s+")
        return probe.rlike(opens) | p.rlike(V.OUTSIDE_BODIES) | (item & ~F.coalesce(T.contains_any(before, T.strings(V.SUMMARY_LEAD_INS)), F.lit(False)))

    def cut(ps: Column) -> Column:
        # all pieces before the first that ends it are kept, so each is judged by the one before it, and the array is cut once
        stop = F.array_position(F.transform(ps, lambda p, i: (i > 0) & ends(p, F.get(ps, i - 1))), F.lit(True)).cast("int")
        kept = F.array_join(F.transform(F.slice(ps, F.lit(1), F.greatest(stop - 1, F.lit(0))), T.strip), " ")
        return F.when(stop > 0, F.concat(kept, F.lit("\n\n" + V.TRIM_NOTICE)))

    kept = T.let(pieces, cut)
    return F.when(whole == "", text).otherwise(F.coalesce(kept, whole))


def with_warning(text: Column, numbers: Column) -> Column:
    """The answer with a note on the numbers that its evidence does not have."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    note = F.concat(bare, F.lit(V.UNVERIFIED_NOTE), F.array_join(numbers, ", "), F.when(F.size(numbers) > 1, V.UNVERIFIED_MANY).otherwise(V.UNVERIFIED_ONE))
    return F.when(F.size(numbers) > 0, note).otherwise(text)


def plain_fallback(names: Column) -> Column:
    """The answer made of document names alone."""
    listed = F.array_join(F.transform(F.array_distinct(names), lambda n: F.concat(F.lit("\n- "), n)), "")
    return F.when(F.size(names) == 0, F.lit(V.FALLBACK_NONE)).otherwise(F.concat(F.lit(V.FALLBACK_HEAD), listed))


def context_block(chunks: DataFrame) -> DataFrame:
    """query_id, block: numbered sources in rank order. chunks: query_id, rank, document_name, page_number, section, text."""
    source = lambda c: F.concat(
        F.lit("--- SOURCE "), c["rank"].cast("string"), F.lit(" ---\nDOCUMENT: "), c["document_name"], F.lit("\nPAGE: "), c["page_number"].cast("string"),
        F.lit("\nSECTION: "), F.coalesce(F.nullif(c["section"], F.lit("")), F.lit("(none)")), F.lit("\nCONTENT:\n"), c["text"], F.lit("\n--- END SOURCE "), c["rank"].cast("string"), F.lit(" ---"),
    )
    rows = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_name", "page_number", "section", "text"))).alias("c"))
    return rows.select("query_id", F.concat_ws("\n\n", F.lit(V.CONTEXT_HEAD), F.array_join(F.transform("c", source), "\n\n")).alias("block"))
