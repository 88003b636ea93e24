"""Text structure: pages to sections, clauses, paragraphs, chunks, features, scope, requirements and metadata.

Input pages have document_id, page_number and text; blank or null texts give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T


def sections(pages: DataFrame, heading: str = V.HEADING_LINE, number: str = V.HEADING_NUMBER, drop_preamble: bool = False) -> DataFrame:
    """One row a section: section_pos, section (its number, or null), text with its heading, stripped.

    heading: the pattern of a whole line; number: of the part of it, from its start, that names the section.
    drop_preamble: what comes before the first heading goes.
    """
    split, said = rf"(?md)(?=^{heading}$)", rf"(?s)(?!{V.SPACE})."
    # that something is left is told from the first letter, so texts are stripped once; whether a page has headings is asked once a page
    rows = pages.where(F.col("text").rlike(said)).withColumn("headed", F.col("text").rlike(rf"(?md)^{heading}$") if drop_preamble else F.lit(False))
    rows = rows.select("*", F.posexplode(F.split("text", split, -1)).alias("section_pos", "raw")).where(F.col("raw").rlike(said))
    rows = rows.withColumn("section", T.first_match(F.col("raw"), rf"(?d)\A(?=(?:{heading})(?:\n|\z))({number})", 1))
    if drop_preamble:
        rows = rows.where(F.col("section").isNotNull() | ~F.col("headed"))
    return rows.withColumn("text", T.strip(F.col("raw"))).drop("raw", "headed")


def clauses(pages: DataFrame, heading: str = V.HEADING_LINE, number: str = V.HEADING_NUMBER) -> DataFrame:
    return sections(pages, heading, number, drop_preamble=True)


def paragraph_list(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), T.strip), lambda x: x != "")


#: Paragraphs whose lengths are folded at once.
PACK_BLOCK = 256


def pack(paragraphs: Column, most: int = V.CHUNK_CHARS, overlap: int = V.OVERLAP_CHARS, separator: str = "\n\n") -> Column:
    """Paragraphs packed in order into chunks of about most characters; a new chunk starts with the end of the one before.

    Where chunks are cut follows from lengths alone: they are folded block by block, first to the length each block starts with,
    then within each block to its cuts; texts are sliced and joined once. What a chunk starts with is the end of all that was
    said before it, since each chunk holds the end of the one before.
    """
    sep, gap = F.lit(separator), len(separator)
    longer = lambda now, n: F.when(now == 0, n).when(now + gap + n <= most, now + gap + n).otherwise(F.least(now, F.lit(overlap)) + gap + n)
    cuts = lambda now, n: (now > 0) & (now + gap + n > most)
    zero, none = F.lit(0), lambda kind: F.array().cast(f"array<{kind}>")
    pair = lambda now, out: F.struct(now.alias("now"), out.alias("out"))

    def joined(ps: Column) -> Column:
        lengths = F.transform(ps, F.length)
        blocks = lambda ls: F.transform(F.sequence(zero, F.floor((F.size(ps) - 1) / PACK_BLOCK).cast("int")), lambda b: F.slice(ls, b * PACK_BLOCK + 1, F.lit(PACK_BLOCK)))
        starts = lambda bs: F.aggregate(
            bs, pair(zero, none("int")), lambda s, b: pair(F.aggregate(b, s["now"], longer), F.concat(s["out"], F.array(s["now"])))
        )["out"]
        within = lambda b, now: F.aggregate(
            b, pair(now, none("boolean")), lambda s, n: pair(longer(s["now"], n), F.concat(s["out"], F.array(cuts(s["now"], n))))
        )["out"]
        flags = T.let(T.let(lengths, blocks), lambda bs: F.flatten(F.zip_with(bs, starts(bs), within)))
        firsts = T.let(flags, lambda fs: F.filter(F.sequence(zero, F.size(ps) - 1), lambda i: (i == 0) | F.get(fs, i)))

        def chunk(at: Column, end: Column) -> Column:
            body = F.array_join(F.slice(ps, at + 1, end - at), separator)
            before = F.array_join(F.slice(ps, F.greatest(at - overlap, zero) + 1, F.least(at, F.lit(overlap))), separator)
            return F.when(at == 0, body).otherwise(F.concat(F.right(before, F.lit(overlap)), sep, body))

        return T.let(firsts, lambda fs: F.transform(fs, lambda at, j: chunk(at, F.coalesce(F.get(fs, j + 1), F.size(ps)))))

    return T.let(paragraphs, lambda ps: F.when(F.size(ps) > 0, joined(ps)).otherwise(none("string")))


def chunks(pages: DataFrame, heading: str = V.HEADING_LINE, separator: str = "\n\n", most: int = V.CHUNK_CHARS, overlap: int = V.OVERLAP_CHARS) -> DataFrame:
    """document_id, chunk_index (running over a document's pages), page_number, section, text."""
    parts = sections(pages.select("document_id", "page_number", "text"), heading)
    packed = parts.select(
        "document_id", "page_number", "section_pos", "section",
        F.posexplode(pack(paragraph_list(F.col("text"), separator), most, overlap)).alias("chunk_pos", "text")
    )
    order = Window.partitionBy("document_id").orderBy("page_number", "section_pos", "chunk_pos")
    return packed.select("document_id", (F.row_number().over(order) - 1).alias("chunk_index"), "page_number", "section", "text")


def number_features(pages: DataFrame, pattern: str = V.STANDARD_NUMBER, kind: str = "standard_number_mention") -> DataFrame:
    found = pages.select("document_id", "page_number", F.posexplode(T.standard_numbers(F.col("text"), pattern)).alias("pos", "value"))
    return found.select("document_id", "page_number", F.lit(kind).alias("feature_type"), "pos", "value", F.lit(None).cast("string").alias("section"))


def heading_features(pages: DataFrame, pattern: str = V.HEADING_PARTS, kind: str = "section_heading") -> DataFrame:
    """pattern: group 1 the number, group 2 the words."""
    pairs = F.arrays_zip(T.all_matches(F.col("text"), pattern, 1).alias("id"), T.all_matches(F.col("text"), pattern, 2).alias("words"))
    found = pages.select("document_id", "page_number", F.posexplode(pairs).alias("pos", "h"))
    return found.select(
        "document_id", "page_number", F.lit(kind).alias("feature_type"), "pos",
        F.concat_ws(" ", "h.id", T.strip(F.col("h.words"))).alias("value"), F.col("h.id").alias("section")
    )


def features(pages: DataFrame) -> DataFrame:
    return number_features(pages).unionByName(heading_features(pages))


def first_pages(pages: DataFrame, most: int = V.METADATA_PAGES) -> DataFrame:
    """document_id, text: the first pages joined by newlines."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    some = pages.withColumn("rank", rank).where(F.col("rank") <= most)
    return some.groupBy("document_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n"
        ).alias("text")
    )


def metadata(pages: DataFrame) -> DataFrame:
    text = F.col("text")
    return first_pages(pages).select(
        "document_id", T.standard_number(text).alias("standard_number"), T.title(text).alias("title"), T.edition(text).alias("edition"),
        T.publication_year(text).alias("publication_year")
    )


def scopes(pages: DataFrame, most: int = V.METADATA_PAGES) -> DataFrame:
    """document_id, page_number, scope_text of the first page with a scope heading, at most one row a document."""
    pattern = rf"(?dm)({V.SCOPE_LINE})[\s\S]*?(?=^{V.HEADING_LINE}$|\z)"
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    found = pages.withColumn("rank", rank).where(F.col("rank") <= most).select(
        "document_id", "page_number", T.blank_to_null(T.strip(F.regexp_extract("text", pattern, 0))).alias("scope_text")
    )
    first = found.where("scope_text is not null").groupBy("document_id").agg(F.min_by(F.struct("page_number", "scope_text"), "page_number").alias("s"))
    return first.select("document_id", "s.page_number", "s.scope_text")


def requirements(
    pages: DataFrame, own_numbers: DataFrame | None = None, heading: str = V.HEADING_LINE, obligation: str = V.OBLIGATION,
    keywords: Mapping[str, Sequence[str]] = V.REQUIREMENT_KEYWORDS, number: str = V.STANDARD_NUMBER
) -> DataFrame:
    """One row a category of each clause with an obligation word: its text and the standards it refers to, without the document's own.

    own_numbers: document_id, standard_number.
    """
    rows = clauses(pages.select("document_id", "page_number", "text"), heading).where(T.states_obligation(F.col("text"), obligation))
    rows = rows.join(own_numbers, "document_id", "left") if own_numbers is not None else rows.withColumn("standard_number", F.lit(None).cast("string"))
    refs = F.filter(T.standard_numbers(F.col("text"), number), lambda x: ~x.eqNullSafe(F.col("standard_number")))
    return rows.select(
        "document_id", "page_number", "section_pos", F.explode(T.requirement_categories(F.col("text"), keywords)).alias("category"),
        F.col("section").alias("clause_number"), F.col("text").alias("requirement_text"), T.blank_to_null(F.array_join(refs, ", ")).alias("referenced_standards"),
    )
