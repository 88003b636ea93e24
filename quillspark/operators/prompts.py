"""Texts made of structured rows: profiles, questions, candidates, checklists, and answers without a model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T

def lines(items: Column, spell) -> Column:
    return F.array_join(F.transform(items, spell), "\n")


def numbered_lines(items: Column, spell) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), spell(x))), "\n")


def profile_summary(profile: Mapping[str, Column]) -> Column:
    known = F.array_compact(F.array(*(F.when(F.length(profile[f]) > 0, F.concat(F.lit(f"- {label}: "), profile[f])) for f, label in V.PROMPT_LABELS.items())))
    return F.when(F.size(known) == 0, F.lit(V.PROFILE_NONE)).otherwise(F.concat(F.lit(V.PROFILE_HEAD + "\n"), F.array_join(known, "\n")))


def questions_block(questions: Column) -> Column:
    """questions: an array of structs with question."""
    asked = F.concat(F.lit(V.QUESTIONS_HEAD + "\n"), numbered_lines(questions, lambda q: q["question"]))
    return F.when(F.size(questions) == 0, F.lit(V.QUESTIONS_NONE)).otherwise(asked)


def checklist_block(items: Column) -> Column:
    """items: an array of structs with category, title, status, regulatory_status, description; null: not assembled."""

    def one(x: Column) -> Column:
        head = F.concat(F.lit("- ["), x["category"], F.lit("] "), x["title"])
        return F.concat(head, F.lit(" — STATUS: "), x["status"], F.lit(", REGULATORY STATUS: "), x["regulatory_status"], F.lit("\n  "), x["description"])

    return (
        F.when(items.isNull(), F.lit(V.CHECKLIST_OPEN))
        .when(F.size(items) == 0, F.lit(V.CHECKLIST_NONE))
        .otherwise(F.concat(F.lit(V.CHECKLIST_HEAD + "\n"), lines(items, one)))
    )


def structured_answer(questions: Column, candidates: Column, requirements: Column) -> Column:
    """An answer without any model's prose. candidates: document_name, status, reason. requirements: category, title, status."""
    asked, found, needed = F.size(questions) > 0, F.size(candidates) > 0, F.size(requirements) > 0
    part = lambda on, head, body: F.when(on, F.concat(F.lit(head + "\n"), body))
    candidate = lambda c: F.concat(F.lit("- "), c["document_name"], F.lit(": "), T.label(c["status"]), F.lit(" — "), c["reason"])
    requirement = lambda r: F.concat(F.lit("- ["), T.label(r["category"]), F.lit("] "), r["title"], F.lit(" ("), T.label(r["status"]), F.lit(")"))
    return F.concat_ws(
        "\n\n",
        part(asked, V.ANSWER_QUESTIONS, numbered_lines(questions, lambda q: q["question"])),
        part(found, V.ANSWER_CANDIDATES, lines(candidates, candidate)),
        F.when(~found & ~asked, F.lit(V.ANSWER_NONE)),
        part(needed, V.ANSWER_REQUIREMENTS, lines(requirements, requirement)),
        F.when(needed, F.lit(V.ANSWER_STATUS)),
    )
