"""Rule-based decisions: profiles folded over turns, clarification questions, applicability, requirements, checklists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T

KEEP, REPLACE, ASK = "KEEP_EXISTING", "REPLACE", "NEEDS_CLARIFICATION"


def parsed_fields(raw: Column, fields: Sequence[str] = V.PROFILE_FIELDS) -> Column:
    """A map of the lines 'field: value' with a known field and a stated value; of repeats the last holds."""
    line = r"(?i)^\s*([a-z_]+)\s*:\s*(.+?)\s*$"
    pairs = F.transform(
        F.split(raw, T.LINE_BREAK, -1),
        lambda x: F.struct(F.lower(F.regexp_extract(x, line, 1)).alias("key"), F.regexp_extract(x, line, 2).alias("value"))
    )
    good = F.filter(pairs, lambda p: p["key"].isin(*fields) & ~F.lower(p["value"]).isin(*V.UNKNOWN_VALUES))
    # the lines are read once a row, not once for each that is kept
    last = T.let(good, lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last)


def category_decision(old: Column, new: Column) -> Column:
    a, b = T.category(old), T.category(new)
    return F.when(old == new, KEEP).when(b.isNotNull() & a.isNull(), REPLACE).when(a.isNotNull() & b.isNotNull() & (a != b), ASK).otherwise(KEEP)


def use_decision(old: Column, new: Column) -> Column:
    a, b = T.intended_use(old), T.intended_use(new)
    return F.when(old == new, KEEP).when(b.isNotNull() & a.isNull(), REPLACE).when(a.isNotNull() & b.isNotNull() & (a != b), ASK).otherwise(KEEP)


def update_decision(field: Column, old: Column, new: Column) -> Column:
    """What becomes of a new value for a field that has one."""
    return F.when(field == "product_category", category_decision(old, new)).when(field == "intended_use", use_decision(old, new)).otherwise(KEEP)


def category_text(old: Column, new: Column) -> Column:
    """The question about two categories of the controlled list."""
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.lit("Earlier you described this as a "), words(old), F.lit(", but this message suggests a "), words(new), F.lit(". Which is correct?"))


def use_text(old: Column, new: Column) -> Column:
    return F.concat(F.lit("Earlier you said this was for "), old, F.lit(" use, but this message suggests "), new, F.lit(" use. Which is correct?"))


def category_question(old: Column, new: Column) -> Column:
    return category_text(T.category(old), T.category(new))


def use_question(old: Column, new: Column) -> Column:
    return use_text(T.intended_use(old), T.intended_use(new))


def fold_profiles(updates: DataFrame, fields: Sequence[str] = V.PROFILE_FIELDS) -> DataFrame:
    """conversation_id, the fields, and the questions of the last turn, from updates (conversation_id, turn, updates: a map).

    The category is settled first in each turn; use and type are then put in its terms. Turns of one conversation are folded
    in order; conversations are independent.
    """
    kind = "struct<" + ",".join(f"{f}:string" for f in fields) + ",questions:array<string>>"
    start = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields), F.array().cast("array<string>").alias("questions")).cast(kind)

    def step(s: Column, u: Column) -> Column:
        new = lambda f: F.element_at(u["updates"], F.lit(f))
        old_c, new_c = s["product_category"], new("product_category")
        decided = category_decision(old_c, new_c)
        named = F.coalesce(T.category(new_c), new_c)
        category = F.when(new_c.isNull(), old_c).when(old_c.isNull() | (decided == REPLACE), named).otherwise(old_c)
        heater = category == "water_heater"
        old_u, new_u = s["intended_use"], new("intended_use")
        use_now = F.when(heater, F.coalesce(T.intended_use(new_u), new_u)).otherwise(new_u)
        use = F.when(new_u.isNull(), old_u).when(old_u.isNull() | (use_decision(old_u, new_u) == REPLACE), use_now).otherwise(old_u)
        type_now = F.when(heater, F.coalesce(T.heater_type(new("product_type")), new("product_type"))).otherwise(new("product_type"))
        value = {"product_category": category, "intended_use": use, "product_type": F.coalesce(s["product_type"], type_now)}
        asked = F.array_compact(F.array(
            F.when(old_c.isNotNull() & new_c.isNotNull() & (decided == ASK), category_question(old_c, new_c)),
            F.when(old_u.isNotNull() & new_u.isNotNull() & (use_decision(old_u, new_u) == ASK), use_question(old_u, new_u)),
        ))
        return F.struct(*(value.get(f, F.coalesce(s[f], new(f))).alias(f) for f in fields), asked.alias("questions")).cast(kind)

    turns = updates.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.map_entries("updates").alias("e")))).alias("turns"))
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(F.map_from_entries(t["e"]).alias("updates"))))
    return turns.select("conversation_id", F.aggregate("turns", start, step).alias("p")).select("conversation_id", "p.*")


def missing_questions(profile: Mapping[str, Column]) -> Column:
    """field, question of what the profile still needs, in order."""
    ask = lambda pairs: F.array_compact(
        F.array(*(F.when(profile[f].isNull(), F.struct(F.lit(f).alias("field"), F.lit(q).alias("question"))) for f, q in pairs))
    )
    category = profile["product_category"]
    out = F.when(F.coalesce(F.length(category), F.lit(0)) == 0, ask(V.GENERIC_QUESTIONS))
    for name, pairs in V.CATEGORY_QUESTIONS.items():
        out = out.when(category == name, ask(pairs))
    return out.otherwise(ask(V.FALLBACK_QUESTIONS))


def is_sufficient(profile: Mapping[str, Column]) -> Column:
    return F.size(missing_questions(profile)) == 0


def applicability(evidence_text: Column, document_name: Column, category: Column, product_type: Column) -> Column:
    """status, reason; evidence_text: all evidence joined by a space."""
    low = F.lower(evidence_text)
    said = lambda c: F.coalesce((F.length(c) > 0) & F.contains(low, F.lower(c)), F.lit(False))
    result = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    unknown = result("NEEDS_CLARIFICATION", F.lit(V.UNKNOWN_CATEGORY))
    likely = result("POTENTIALLY_APPLICABLE", F.concat(F.lit(V.LIKELY_REASON[0]), document_name, F.lit(V.LIKELY_REASON[1])))
    unclear = result("NEEDS_CLARIFICATION", F.concat(document_name, F.lit(V.UNCLEAR_REASON)))
    return F.when(F.coalesce(F.length(category), F.lit(0)) == 0, unknown).when(said(category) | said(product_type), likely).otherwise(unclear)


def assess(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """candidates (query_id, document_name, evidence: chunk_id and text) with status and reason; profiles: query_id, product_category, product_type."""
    rows = candidates.join(profiles.select("query_id", "product_category", "product_type"), "query_id")
    text = F.array_join(F.transform("evidence", lambda e: e["text"]), " ")
    found = applicability(text, F.col("document_name"), F.col("product_category"), F.col("product_type"))
    return rows.withColumn("a", found).select("*", F.col("a.status").alias("applicability_status"), F.col("a.reason").alias("applicability_reason")).drop("a")


def checklist_items(assessed: DataFrame, obligation: str = V.OBLIGATION, keywords: Mapping[str, Sequence[str]] = V.REQUIREMENT_KEYWORDS) -> DataFrame:
    """One row a category of each chunk of evidence that states an obligation, for candidates that may apply."""
    open_ = assessed.where(F.col("applicability_status").isin("APPLICABLE", "POTENTIALLY_APPLICABLE"))
    rows = open_.select("query_id", "document_id", "document_name", "applicability_status", F.posexplode("evidence").alias("pos", "e"))
    rows = rows.where(T.states_obligation(F.col("e.text"), obligation)).select(
        "*", F.explode(T.requirement_categories(F.col("e.text"), keywords)).alias("category")
    )
    return rows.select(
        "query_id", "document_id", F.col("e.chunk_id").alias("chunk_id"), "category", F.concat(T.label(F.col("category")), F.lit(" requirement referenced in "), "document_name").alias("title"),
        T.strip(F.col("e.text")).alias("description"), F.when(F.col("applicability_status") == "APPLICABLE", "CONFIRMED").otherwise("POTENTIALLY_APPLICABLE").alias("status"), F.lit("NOT_DETERMINED").alias("regulatory_status"),
    )


def checklists(queries: DataFrame, items: DataFrame, allowed: Column) -> DataFrame:
    """query_id, items: only where allowed (no conflict is open and enough is known)."""
    lists = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "chunk_id", "category", "title", "status"))).alias("items"))
    return queries.where(allowed).join(lists, "query_id", "left")


def wants_fallback(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, fallback: there are terms, and no candidate may apply. queries: query_id, terms."""
    any_ = candidates.groupBy("query_id").agg(F.bool_or(F.col("applicability_status").isin("APPLICABLE", "POTENTIALLY_APPLICABLE")).alias("any"))
    return queries.join(any_, "query_id", "left").select("query_id", ((F.size("terms") > 0) & ~F.coalesce("any", F.lit(False))).alias("fallback"))


def fallback_query(product_type: Column, product_name: Column, product_category: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (product_type, product_name, product_category)))
