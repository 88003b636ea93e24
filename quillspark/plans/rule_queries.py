"""Named queries of the rule layer: metadata, answer checks, requests, retrieval and discovery from end to end.

The driver's tables have no standard numbers or headings, so texts that have them are made inside the queries, by
expressions that mean the same in Spark's SQL and in DuckDB's; the operators run with their own patterns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as X
from quillspark.operators import attempts, catalogue, chunking, dictionary, embedding, ingest, lifecycle, prompts, rules, safety, search
from quillspark.plans import discovery
from quillspark.plans.tables import first_words, table
from quillspark.session import shared_dir
from quillspark.sources import documents as pages_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Pages of a made standard for each part.
PAGE_1 = """concat('Foreword', chr(10), CASE WHEN p_size % 6 = 5 THEN '' ELSE concat('  Indian Standard', chr(10)) END, upper(p_name), chr(10), 'SPECIFICATION FOR ', p_brand, chr(10),
    CASE p_size % 4 WHEN 0 THEN '( First Revision )' WHEN 1 THEN concat('second', chr(160), 'reprint') WHEN 2 THEN 'ICS 97.100' ELSE concat('3.', p_size, ' Tenth Edition') END, chr(10), 'IS ', 100 + p_partkey, ' : ', 1950 + p_size, chr(10),
    'in ', 1940 + p_size, ' and ', 2000 + p_size % 9, chr(10), CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('1 SCOPE', chr(10)) END, 'This covers IS/ISO ', 2800 + p_size, '-1 and IS ', 100 + p_partkey, ' only.', chr(10), chr(10),
    'More of it.', chr(10), '2.1 References, other (A-B)', chr(10), 'IS ', 300 + p_size, ' : 2 and IS', 456 + p_size % 3, chr(10))"""
PAGE_2 = """concat(CASE WHEN p_size % 7 = 0 THEN concat('Scope  ', chr(10), 'Second page of ', p_name, chr(10)) ELSE concat('tail of ', p_name, chr(10)) END, '3.1', chr(160), 'Marking', chr(10), 'Each unit shall be marked with IS ', 100 + p_partkey, ' or IS ', 302 + p_size % 5, '.', chr(10),
    '4 TESTS', chr(10), CASE WHEN p_size % 2 = 0 THEN 'The sample must be tested and certified.' ELSE 'Nothing is asked for.' END, chr(10), '4.', p_size, '.1 Drawing', chr(10), 'a drawing of quality control is a requirement, see IS 99999', chr(10))"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def standard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("document_id"), F.posexplode(F.array(F.expr(PAGE_1), F.expr(PAGE_2))).alias("pos", "text")
    ).select("document_id", (F.col("pos") + 1).alias("page_number"), "text")


@query
def standard_metadata(spark, sf_dir):
    """Number, title, edition and year of a standard's first pages."""
    return chunking.metadata(standard_pages(spark, sf_dir))


@query
def standard_scopes(spark, sf_dir):
    """The first page's text under a scope heading."""
    return chunking.scopes(standard_pages(spark, sf_dir))


@query
def standard_features(spark, sf_dir):
    """Numbers and headings of every page."""
    return chunking.features(standard_pages(spark, sf_dir))


@query
def standard_clauses(spark, sf_dir):
    """Numbered clauses by the operators' own heading pattern."""
    rows = chunking.clauses(standard_pages(spark, sf_dir))
    return rows.select("document_id", "page_number", "section", "text")


@query
def standard_requirements(spark, sf_dir):
    """Requirements with what they refer to besides their own standard."""
    pages = standard_pages(spark, sf_dir)
    rows = chunking.requirements(pages, chunking.metadata(pages).select("document_id", "standard_number"))
    return rows.select("document_id", "page_number", "category", "clause_number", "requirement_text", "referenced_standards")


#: An answer for each part, with numbers that its evidence has and others; and what it says of the profile.
ANSWER = """concat('The ', p_name, ' follows IS ', 100 + p_partkey, ' and IS  ', 200 + p_size, CASE WHEN p_size % 3 = 0 THEN concat(', IS/ISO ', 2000 + p_size, '-1') ELSE '' END, '. ',
    CASE WHEN p_size % 5 = 0 THEN 'It is mandatory! ' WHEN p_size % 5 = 1 THEN 'It is not mandatory. ' ELSE 'It may apply? ' END, CASE WHEN p_size % 4 = 0 THEN concat(chr(10), '- **Testing: by a lab') ELSE '' END, chr(10),
    'Category: ', CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Other Thing' END, chr(10), 'capacity : ** ', p_size, ' L**', chr(10), 'IS ', 200 + p_size)"""


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").alias("answer_id"), F.expr(ANSWER).alias("text"), (F.col("p_size") % 3).alias("n_requirements"),
        F.lower("p_type").alias("product_category"), F.concat("p_size", F.lit(" l")).alias("capacity")
    )
    names = F.array(F.concat(F.lit("IS "), F.col("p_partkey") + 100, F.lit(".pdf")), F.concat(F.lit("doc_is_"), F.col("p_size") + 200, F.lit(".pdf")))
    texts = F.array(F.concat(F.lit("says IS "), F.col("p_size") + 2000), F.lit("nothing"))
    evidence = part.where("p_size % 10 < 8").select(
        F.col("p_partkey").alias("answer_id"), F.explode(F.arrays_zip(names.alias("n"), texts.alias("t"))).alias("e")
    ).select("answer_id", F.col("e.n").alias("document_name"), F.col("e.t").alias("text"))
    return rows, evidence


@query
def answer_verdicts(spark, sf_dir):
    """What an answer claims without evidence."""
    rows, evidence = answers(spark, sf_dir)
    found = safety.verdict(rows, evidence, {"product_category": "product_category", "capacity": "capacity"})
    return found.select(
        "answer_id", F.array_join("fabricated_numbers", "|").alias("fabricated"), "mandatory_claim", "checklist_claim", "profile_claim",
        "is_safe"
    )


@query
def answer_unverified(spark, sf_dir):
    """Numbers whose base no evidence has, each in its first spelling."""
    return safety.unverified_numbers(*answers(spark, sf_dir)).select("answer_id", F.array_join("unverified", "|").alias("unverified"))


#: An answer on a question off the corpus, by sentences, lines and list items.
SPECULATION = """concat(CASE p_size % 3 WHEN 0 THEN 'The documents provided cover:' WHEN 1 THEN 'These documents are on paint.' ELSE 'Typically, you need a lab.' END, chr(10), '- ', p_name, '. ', chr(10), chr(10),
    CASE p_size % 4 WHEN 0 THEN 'Generally this is so.' WHEN 1 THEN 'It follows IEC rules!' WHEN 2 THEN concat('2) ', p_brand, ' item') ELSE 'They say no more?' END, ' Last words of ', p_type, '.')"""


@query
def answer_trims(spark, sf_dir):
    """Answers cut where they stop reporting the documents."""
    return table(spark, sf_dir, "part").select("p_partkey", safety.trimmed(F.expr(SPECULATION)).alias("text"))


@query
def answer_notes(spark, sf_dir):
    """Warnings and answers made of names alone."""
    number = F.concat(F.lit("IS "), F.col("p_partkey") + 100)
    numbers = F.when(
        F.col("p_size") % 3 == 0, F.array().cast("array<string>")
    ).when(F.col("p_size") % 3 == 1, F.array(number)).otherwise(F.array(number, F.lit("IS 7")))
    names = F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_brand", "p_name")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", safety.with_warning(F.concat("p_name", F.lit(" \n")), numbers).alias("warned"),
        safety.plain_fallback(names).alias("fallback")
    )


@query
def rephrases(spark, sf_dir):
    """Which new wordings may stand for the old."""
    new = F.when(F.col("p_size") % 4 == 0, "").when(
        F.col("p_size") % 4 == 1, F.concat("p_name", F.lit("\n"), "p_type")
    ).when(F.col("p_size") % 4 == 2, F.repeat("p_name", F.lit(6))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_safe_rephrase(new, F.col("p_name")).alias("safe"))


@query
def prompt_texts(spark, sf_dir):
    """The blocks of a prompt."""
    profile = {f: F.lit(None).cast("string") for f in T.V.PROFILE_FIELDS} | {
        "product_name": F.when(F.col("p_size") % 2 == 0, F.col("p_name")), "product_category": F.lower("p_type"), "capacity": F.lit("")
    }
    asked = rules.missing_questions(profile)
    one = F.struct(
        F.lit("MARKING").alias("category"), F.col("p_name").alias("title"), F.lit("CONFIRMED").alias("status"),
        F.lit("NOT_DETERMINED").alias("regulatory_status"), F.col("p_type").alias("description")
    )
    items = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 3 == 1, F.filter(F.array(one), lambda x: F.lit(False))).otherwise(F.array(one, one))
    language = F.when(F.col("p_size") % 3 == 0, "en").when(F.col("p_size") % 3 == 1, "hi").otherwise("ta")
    sections = prompts.profile_summary(profile), prompts.questions_block(asked), prompts.checklist_block(items), T.language_instruction(language)
    return table(spark, sf_dir, "part").select(
        "p_partkey", *(c.alias(n) for c, n in zip(sections, ("profile", "questions", "checklist", "language"), strict=True))
    )


@query
def request_checks(spark, sf_dir):
    """Why requests are refused."""
    key = F.col("c_custkey")
    text = F.when(key % 5 == 0, "  ").when(key % 5 == 1, F.repeat("c_name", F.lit(60))).otherwise(F.col("c_name"))
    pin = F.when(key % 3 == 0, "12").when(key % 3 == 1, "1a").otherwise("123")
    language, mode = F.when(key % 4 == 0, "hi").when(key % 4 == 1, "fr"), F.when(key % 7 == 0, "product_discovery").when(key % 7 == 1, "chat")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", discovery.query_problem(text, key % 25).alias("query"),
        discovery.message_problem(F.repeat(text, F.lit(5)), language, mode).alias("message"),
        discovery.user_problem(text, pin).alias("user")
    )


@query
def parsed_profile_fields(spark, sf_dir):
    """A profile out of lines, known fields and stated values only, the last of repeats."""
    raw = F.concat(
        F.lit("product_name: "), "p_name", F.lit("\nBogus: x\nCAPACITY : "),
        F.when(F.col("p_size") % 2 == 0, "Unknown").otherwise(F.col("p_size").cast("string")), F.lit("\r\nmaterials:a: b \nmaterials: "),
        "p_type", F.lit("\nno colon\ntechnology:")
    )
    fields = rules.parsed_fields(raw)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(fields).alias("n"),
        *(F.element_at(fields, F.lit(f)).alias(f) for f in ("product_name", "capacity", "materials", "technology"))
    )


@query
def page_texts(spark, sf_dir):
    """Which text a page uses, and detected tables as text."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  \n"), F.substr("p_name", F.lit(1), F.lit(9)), F.lit(" "))).otherwise(F.col("p_name"))
    cells = F.array(F.array(F.lit("Size"), F.lit("Type")), F.array(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))))
    return table(spark, sf_dir, "part").select("p_partkey", pages_of.page_method(text).alias("method"), T.table_block(cells).alias("block"))


@query
def scanned_pages(spark, sf_dir):
    """Recognised words joined, and the mean of their confidences."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    words = words.select(
        "document_id", (F.col("pos") % 3).alias("page_number"), "pos",
        F.when(F.col("pos") % 11 == 4, " ").otherwise(F.col("word")).alias("word"), (F.col("pos") * 7 % 102 - 1).alias("confidence")
    )
    rows = pages_of.pages_from_words(words.withColumn("confidence", F.col("confidence").cast("double")))
    return rows.select("document_id", "page_number", "text", F.round("ocr_confidence", 6).alias("ocr_confidence"))


@query
def appended_rows(spark, sf_dir):
    """New rows beside those that are there."""
    labels = table(spark, sf_dir, "labels")
    return ingest.appended(labels, labels.where("quality = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "toxic", "quality"))


@query
def document_types(spark, sf_dir):
    """The domain of document types."""
    kind = F.when(F.col("p_size") % 5 == 0, "QCO").when(F.col("p_size") % 5 == 1, "").when(F.col("p_size") % 5 == 2, "qco").when(F.col("p_size") % 5 == 3, "OTHER")
    return table(spark, sf_dir, "part").select("p_partkey", ingest.checked_type(kind).alias("document_type"))


@query
def owned_fetch(spark, sf_dir):
    """nobody's rows and an owner's, by one rule."""
    rows = table(spark, sf_dir, "events").withColumn("owner", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 5))
    nobody, third = catalogue.owned_by(rows, F.lit(None), "owner"), catalogue.owned_by(rows, F.lit(3), "owner")
    return nobody.unionByName(third).select("event_id", "owner")


@query
def document_states(spark, sf_dir):
    """A document's state from the errors of its stages."""
    error = lambda n: F.when(F.col("p_size") % n == 0, "failed there")
    return table(spark, sf_dir, "part").select(
        "p_partkey", ingest.stage_status({"text": error(5), "metadata": error(2), "features": error(7), "scope": error(3)}).alias("status")
    )


STATUSES = ["processing", "text_extracted", "features_extracted", "completed", "failed", "processing", "paused"]


def _stage_events(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("event_id") * 5 % 7).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "ts", "event_id", status.alias("status"))


@query
def stage_transitions(spark, sf_dir):
    """Each event's state before and after, and whether it was a legal step."""
    return lifecycle.transitions(_stage_events(spark, sf_dir), "document_id", ["ts", "event_id"]).drop("ts")


@query
def stage_states(spark, sf_dir):
    """The state that a document's events lead to."""
    return lifecycle.final_states(lifecycle.transitions(_stage_events(spark, sf_dir), "document_id", ["ts", "event_id"]), "document_id", ["ts", "event_id"])


@query
def external_attempts(spark, sf_dir):
    """Results of a search tried in order, up to the first success or duplicate; one search for each supplier."""
    lines = table(spark, sf_dir, "lineitem")
    content = F.sha2((F.col("l_partkey") % 97).cast("string").cast("binary"), 256)
    results = lines.select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("position"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("identifier"),
        F.when(F.col("l_quantity") >= 8, content).alias("content_hash"), (F.col("l_tax") == 0).alias("refused"), (F.col("l_returnflag") != "N").alias("completed"),
    )
    known = table(spark, sf_dir, "part").where("p_partkey < 5").select(F.sha2((F.col("p_partkey") % 97).cast("string").cast("binary"), 256).alias("content_hash"))
    return attempts.attempts(results, known).drop("content_hash")


def _words(spark, sf_dir, least):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.where(F.length("word") >= least).distinct()


@query
def dictionary_parts(spark, sf_dir):
    """Every word of the questions searched in two columns of the catalogue."""
    asked = _words(spark, sf_dir, 1).select(F.col("word").alias("query_id"), F.col("word").alias("words"))
    found = dictionary.found_in_any(table(spark, sf_dir, "part"), asked, "p_partkey", ["p_name", "p_type"])
    return found.withColumnRenamed("query_id", "word")


@query
def dictionary_categories(spark, sf_dir):
    """Documents with any keyword of a category; the keywords are a table, a category its first letter."""
    words = _words(spark, sf_dir, 9).select(F.left("word", F.lit(1)).alias("category"), F.col("word").alias("keyword"))
    return dictionary.categories(table(spark, sf_dir, "documents"), words, "doc_id")


@query
def reindex_completed(spark, sf_dir):
    """Only completed documents are indexed anew."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    status = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "completed").otherwise("processing").alias("status"))
    return ingest.reindexed(docs, docs.where("source <> 'src0'").withColumn("n_chars", -F.col("n_chars")), status, "doc_id")


@query
def fallbacks(spark, sf_dir):
    """Who goes on to the archive, and with what."""
    part = table(spark, sf_dir, "part")
    queries = part.select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("terms")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query_id"),
        F.when(F.col("l_returnflag") == "A", "POTENTIALLY_APPLICABLE").otherwise("NEEDS_CLARIFICATION").alias("applicability_status")
    )
    said = part.select(
        F.col("p_partkey").alias("query_id"),
        rules.fallback_query(
            F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")), F.when(F.col("p_size") % 3 == 0, F.col("p_name")),
            F.lower("p_brand")
        ).alias("words")
    )
    return rules.wants_fallback(lines, queries).join(said, "query_id")


@query
def evidence_standards(spark, sf_dir):
    """Evidence and standards by the table that links them."""
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = catalogue.bridged(
        table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), links,
        table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "o_orderkey = l_orderkey", "l_partkey = p_partkey"
    )
    return rows.select("o_orderkey", "p_partkey", "p_brand")


@query
def session_users(spark, sf_dir):
    """Tokens to users; unknown and expired ones give nobody."""
    sessions = table(spark, sf_dir, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("expires")
    )
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    asked = table(spark, sf_dir, "lineitem").select(F.sha2((F.col("l_orderkey") * 2).cast("string"), 256).alias("token"))
    return catalogue.users_of(asked, sessions, users).select("token", "user_id", "username")


@query
def touched(spark, sf_dir):
    """The time of the run, kept out of the values."""
    return table(spark, sf_dir, "events").select("event_id", (F.current_timestamp() > F.col("ts")).alias("later"))


@query
def unit_vectors(spark, sf_dir):
    """Prefixed passages embedded and brought to length one."""
    v = X.unit(T.hash_embedding(F.concat(F.lit(discovery.PASSAGE_PREFIX), "text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    return rows.select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("v0"), F.round(X.squared_norm(F.col("v")), 6).alias("norm"))


def world(spark: SparkSession, sf_dir: str, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks and documents for the question flows: texts with standard numbers; every fifth document's row is missing.

    Chunks are a table in the shared folder, as each text is embedded (and, with words, tokenised) once, however many searches read it.
    """
    docs = table(spark, sf_dir, "documents")
    own = F.concat(F.lit("D"), F.col("doc_id") % 60)
    text = F.concat("text", F.lit(" IS "), F.col("doc_id") % 50 + 100)
    chunks = docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), own.alias("document_id"), F.lit(1).alias("page_number"),
        F.lit(None).cast("string").alias("section"), text.alias("text")
    )
    chunks = chunks.withColumn(
        "embedding", T.hash_embedding(F.concat(F.lit(discovery.PASSAGE_PREFIX), "text"))
    )
    chunks = chunks.withColumn("toks", T.tokens(F.col("text"))).withColumn("dl", T.n_tokens(F.col("text"))) if words else chunks
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.write.parquet(path)
    chunks = spark.read.schema(chunks.schema).parquet(path)
    no = F.col("id")
    kind = F.when(no % 3 == 0, "TESTING_GUIDANCE").when(no % 3 == 1, "INDIAN_STANDARD").otherwise("OTHER")
    documents = table(spark, sf_dir, "documents").select((F.col("doc_id") % 60).alias("id")).distinct().where("id % 5 <> 4").select(
        F.concat(F.lit("D"), no).alias("document_id"), F.concat(F.lit("d"), no, F.lit(".pdf")).alias("document_name"),
        kind.alias("document_type"), F.concat(F.lit("s"), no % 7).alias("standard_id")
    )
    return chunks, documents


@query
def table_pages(spark, sf_dir):
    """Each order's page, with the flattened lines of its table replaced by a block of rows."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string")), F.when(F.col("l_tax") > 0, F.col("l_returnflag")))
    flat = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.when(F.col("l_tax") > 0, F.col("l_returnflag")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", cells.alias("cells"), flat.alias("flat")).alias("x"))
    pages = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    region = F.array_join(F.col("x.flat"), "\n")
    text = F.concat(F.lit("Order "), F.col("l_orderkey"), F.lit("\n"), F.when(F.col("l_orderkey") % 4 == 0, F.upper(region)).otherwise(region), F.lit("\n"), region)
    found = F.array(F.struct(F.concat(F.lit(" "), region, F.lit("\n")).alias("flat"), F.col("x.cells").alias("rows")))
    return pages.select("l_orderkey", F.sha2(T.with_table_blocks(text, found), 256).alias("sha256"))


@query
def embedded_documents(spark, sf_dir):
    """Documents embedded in batches by a model of 384 dimensions: three moments of each vector."""
    embed = embedding.hashed_gram_embedder()
    rows = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    moment = lambda f: F.round(F.aggregate(F.transform("v", lambda x, i: f(x.cast("double"), i)), F.lit(0.0), lambda s, x: s + x), 2)
    return rows.select(
        "doc_id", F.lit(embed.name).alias("model"), F.size("v").alias("dimension"), moment(lambda x, i: x * x).alias("norm"),
        moment(lambda x, i: x * i / 384).alias("mean_place"), moment(lambda x, i: F.when(x > 0, 1.0).otherwise(0.0)).alias("n_places"),
    )


@query
def restricted_retrieval(spark, sf_dir):
    """Questions free, within a document, within a standard's documents; of some types only."""
    chunks, documents = world(spark, sf_dir)
    item = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"), "text", F.when(item % 3 == 1, F.concat(F.lit("D"), item % 60 - (item % 5 == 4).cast("int"))).alias("document_id"),
        F.when(item % 3 == 2, F.concat(F.lit("s"), item % 9)).alias("standard_id")
    )
    rows = discovery.retrieve(asked, chunks, documents, top_k=4, types=["INDIAN_STANDARD", "OTHER"])
    return rows.select("query_id", "rank", "chunk_id", "document_id", "document_name", "document_type", F.round("score", 6).alias("score"))


@query
def plain_turns(spark, sf_dir):
    """Plain chat turns from retrieval over the off-corpus cut to the note on unverified numbers."""
    chunks, documents = world(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    answer = F.concat(F.lit("The documents name IS "), F.col("query_id") % 60 + 100, F.lit(". Generally, IS 99999 and IS 77777 are asked for."))
    rows = discovery.plain_turns(asked, asked.select("query_id", answer.alias("answer")), chunks, documents)
    return rows.withColumn("unverified", F.array_join("unverified", ",")).withColumn("citations", F.array_join("citations", ","))


def made_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = first_words(spark, sf_dir, 4)
    said = {
        "product_name": F.concat_ws(" ", F.get("words", F.lit(0)), F.get("words", F.lit(1))), "product_category": F.get("words", F.lit(2)),
        "product_type": F.get("words", F.lit(3))
    }
    query_ = F.when(
        F.col("query_id") % 3 == 0, F.concat(F.lit("which test method of IS "), F.col("query_id") % 50 + 100)
    ).when(F.col("query_id") % 3 == 1, "the law")
    return words.select(
        "query_id", query_.alias("user_query"), *(said.get(f, F.lit(None).cast("string")).alias(f) for f in T.V.PROFILE_FIELDS),
        (F.col("query_id") % 4 == 0).cast("int").alias("conflicts")
    )


@query
def discovery_candidates(spark, sf_dir):
    """Profiles to ranked documents with their applicability, from end to end."""
    assessed, _, _ = discovery.discover(made_profiles(spark, sf_dir), *world(spark, sf_dir, words=True))
    rounded = [F.round(c, 6).alias(c) for c in ("final_score", "semantic_score", "keyword_score")]
    return assessed.select(
        "query_id", "rank", "document_id", *rounded, "document_type_boost", "exact_identifier_boost", "profile_attribute_boost",
        F.array_join("matched_terms", "|").alias("matched_terms"), F.size("evidence").alias("n_evidence"), "applicability_status"
    )


@query
def discovery_gate(spark, sf_dir):
    """What is still asked, and who may have a checklist."""
    profiles = made_profiles(spark, sf_dir)
    profiles = profiles.withColumn("product_category", F.when(F.col("query_id") % 2 == 0, "water_purifier").otherwise(F.col("product_category")))
    for f in ("technology", "intended_use", "electrical_characteristics", "capacity"):
        profiles = profiles.withColumn(f, F.when(F.col("query_id") % 6 != 0, F.lit("stated")))
    fields = {f: F.col(f) for f in T.V.PROFILE_FIELDS}
    open_ = profiles.select("query_id", "conflicts", rules.missing_questions(fields).alias("questions"))
    items = profiles.select(
        "query_id", F.lit("d").alias("document_id"), F.lit("c").alias("chunk_id"), F.lit("TESTING").alias("category"),
        F.lit("t").alias("title"), F.lit("s").alias("status")
    ).where("query_id % 8 <> 2")
    lists = rules.checklists(open_, items, (F.size("questions") == 0) & (F.col("conflicts") == 0))
    return open_.join(lists.select("query_id", F.lit(True).alias("gated"), "items"), "query_id", "left").select(
        "query_id", F.size("questions").alias("n_questions"), F.coalesce("gated", F.lit(False)).alias("gated"),
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items")
    )


@query
def eval_topk_hits(spark, sf_dir):
    """How often the first vector of a question's own label is found, and by which place."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    ranked = search.vector_top_k(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), vectors, 30)
    first = vectors.where("vec_id % 50 <> 0").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    expected = asked.select(F.col("vec_id").alias("query_id"), "label").join(first, "label").select("query_id", "vec_id")
    return search.evaluate(ranked, expected, "vec_id", (1, 3, 10, 30))
