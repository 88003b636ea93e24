"""The two question flows end to end: plain retrieval, and product discovery.

An embedder is any function from a text column to a vector column: a batch embedder (`operators.embedding`) for a model,
or the hash embedder of tests. Questions and passages carry their prefixes only on the way to it, and only vectors of
the questions' own model are compared with them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T
from quillspark.operators import chunking, hybrid, rules, safety, search
from quillspark.operators.embedding import model_name
from quillspark.session import shared_dir

Embedder = Callable[[Column], Column]

# fixed values
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "
UNKNOWN_DOCUMENT = "(unknown document)"
MOST_TOP_K, MOST_QUERY_CHARS, MOST_MESSAGE_CHARS, PIN_DIGITS = 20, 1000, 4000, 2
MODES = ["product_discovery"]


def query_problem(query: Column, top_k: Column) -> Column:
    """Why a retrieval request is refused; null if it is taken."""
    n = F.length(T.strip(query))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > MOST_QUERY_CHARS, "too long").when(~top_k.between(1, MOST_TOP_K), "top_k out of range")


def message_problem(message: Column, language: Column, mode: Column) -> Column:
    return F.when(F.length(message) > MOST_MESSAGE_CHARS, "too long").when(
        language.isNotNull() & ~language.isin(*V.LANGUAGE_NAMES), "unsupported language"
    ).when(mode.isNotNull() & ~mode.isin(*MODES), "unsupported mode")


def user_problem(username: Column, pin: Column) -> Column:
    return F.when(F.length(T.strip(username)) == 0, "blank name").when(~pin.rlike(rf"^[0-9]{{{PIN_DIGITS}}}$"), "bad pin")


def index(pages: DataFrame, embed: Embedder = T.hash_embedding, **options) -> DataFrame:
    """Chunks with chunk_id, embedding and its model, toks and dl: the one table that all searches read."""
    chunks = chunking.chunks(pages, **options)
    name = F.sha2(F.concat_ws("|", "document_id", "chunk_index"), 256)
    return chunks.select(
        name.alias("chunk_id"), "*", embed(F.concat(F.lit(PASSAGE_PREFIX), "text")).alias("embedding"),
        F.lit(model_name(embed)).alias("embedding_model"), T.tokens(F.col("text")).alias("toks"), T.n_tokens(F.col("text")).alias("dl")
    )


RESTRICTIONS = "document_id", "standard_id"


def linked(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, document_id that a restricted question may find: its document, or those of its standard.

    questions: query_id, document_id, standard_id (both nullable); a question that gives both, or a document that doesn't exist,
    is an error. A standard without documents finds nothing.
    """
    both = F.col("want_doc").isNotNull() & F.col("want_std").isNotNull()
    asked = questions.select("query_id", F.col("document_id").alias("want_doc"), F.col("standard_id").alias("want_std"))
    asked = asked.where(F.when(both, F.raise_error(F.lit("document_id and standard_id exclude each other")).cast("boolean")).otherwise(True))
    named = asked.where("want_doc is not null").join(documents.select("document_id").distinct(), F.col("want_doc") == F.col("document_id"), "left")
    unknown = F.raise_error(F.concat(F.lit("there is no document "), F.col("want_doc"))).cast("string")
    one = named.select("query_id", F.coalesce("document_id", unknown).alias("document_id"))
    some = asked.join(documents, F.col("want_std") == documents["standard_id"]).select("query_id", "document_id")
    return one.unionByName(some)


def retrieve(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Embedder = T.hash_embedding, top_k: int = 5,
    types: Sequence[str] | None = None
) -> DataFrame:
    """query_id, rank, chunk_id, document_id, document_name, document_type, page_number, section, text, score.

    questions: query_id, text, and where they may be restricted document_id and standard_id (nullable).
    documents: document_id, document_name, document_type, standard_id.
    """
    parents = documents if types is None else documents.where(F.col("document_type").isin(*types))
    for c in RESTRICTIONS:
        questions = questions if c in questions.columns else questions.withColumn(c, F.lit(None).cast("string"))
    free = F.col("document_id").isNull() & F.col("standard_id").isNull()
    vectors = lambda rows: rows.select("query_id", embed(F.concat(F.lit(QUERY_PREFIX), "text")).alias("query_vector"))
    of = {"key": "chunk_id", "parents": parents, "model": model_name(embed) if "embedding_model" in chunks.columns else None}
    hits = search.vector_top_k(vectors(questions.where(free)), chunks, top_k, **of)
    few = search.vector_top_k(vectors(questions.where(~free)), chunks, top_k, allowed=linked(questions, documents), **of)
    found = hits.unionByName(few).join(chunks.select("chunk_id", "document_id", "page_number", "section", "text"), "chunk_id")
    rows = found.join(documents.select("document_id", "document_name", "document_type"), "document_id", "left")
    return rows.select(
        "query_id", "rank", "chunk_id", "document_id", F.coalesce("document_name", F.lit(UNKNOWN_DOCUMENT)).alias("document_name"),
        "document_type", "page_number", "section", "text", "score"
    )


def plain_turns(
    questions: DataFrame, answers: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Embedder = T.hash_embedding, top_k: int = 5
) -> DataFrame:
    """query_id, off_corpus, unverified, content, citations: plain chat turns from retrieval to what is shown.

    questions: as for retrieve. answers: query_id, answer, the model's text. Where the evidence is not about the question, the answer is
    cut where it stops reporting it; numbers of standards that no evidence has are named in a note. citations: the
    chunks found, best first. A question without an answer drops out; one without evidence keeps its answer and cites nothing.
    """
    found = retrieve(questions, chunks, documents, embed, top_k)
    shared_dir(questions.sparkSession)
    found = found.select("query_id", "rank", "chunk_id", "document_name", "text").checkpoint(eager=True)  # read three times: a few rows a question
    judged = search.off_corpus(questions, found).select("query_id", "off_corpus")
    said = answers.join(judged, "query_id").withColumn("text", F.when(F.col("off_corpus"), safety.trimmed(F.col("answer"))).otherwise(F.col("answer")))
    one = F.col("query_id").alias("answer_id")
    checked = safety.unverified_numbers(said.select(one, "text"), found.select(one, "document_name", "text")).withColumnRenamed("answer_id", "query_id")
    cited = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].alias("citations"))
    rows = said.join(checked, "query_id").join(cited, "query_id", "left")
    content, citations = safety.with_warning(F.col("text"), F.col("unverified")), F.coalesce("citations", F.array().cast("array<string>"))
    return rows.select("query_id", "off_corpus", "unverified", content.alias("content"), citations.alias("citations"))


def asked_of(profiles: DataFrame) -> DataFrame:
    """profiles (query_id, user_query, the profile fields) with terms, identifiers and text; profiles without any drop out."""
    fields = {f: F.col(f) for f in V.PROFILE_FIELDS}
    numbers = lambda c: F.coalesce(T.standard_numbers(F.col(c)), F.array().cast("array<string>"))
    rows = profiles.withColumn("terms", T.search_terms(fields)).withColumn("identifiers", F.concat(numbers("user_query"), numbers("other_attributes")))
    text = F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.array_join("identifiers", " "))
    return rows.withColumn("text", text).where((F.size("terms") > 0) | (F.size("identifiers") > 0))


def find_candidates(
    profiles: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Embedder = T.hash_embedding, top_k: int = V.TOP_CANDIDATES,
    quote: bool = False
) -> DataFrame:
    """Documents for each profile, ranked: twenty chunks by vector and twenty by each term, merged and scored.

    A profile's standard_id, if there is such a column, restricts the vector hits only. quote searches terms that the query language can't take as phrases.
    """
    asked = asked_of(profiles)
    semantic = retrieve(asked, chunks, documents, embed, V.POOL_SEMANTIC)
    terms = asked.select("query_id", F.posexplode(F.concat("terms", "identifiers")).alias("term_pos", "term"))
    keyword = search.best_term(chunks.select("chunk_id", "toks", "dl"), terms, V.POOL_KEYWORD, "chunk_id", quote)
    favoured = F.when(F.length("user_query") > 0, T.prioritised_types(T.query_classes(F.col("user_query")))).otherwise(F.array().cast("array<string>"))
    queries = asked.select(
        "query_id", "identifiers", F.array("product_category", "product_type", "technology").alias("attributes"),
        favoured.alias("priority_types")
    )
    return hybrid.rerank(hybrid.merge(semantic, keyword, chunks, documents), queries, top_k)


def discover(
    profiles: DataFrame, chunks: DataFrame, documents: DataFrame, embed: Embedder = T.hash_embedding, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with their applicability, the questions still open (query_id, questions), and checklists where nothing is open.

    profiles may have conflicts, the number of unresolved ones.
    """
    fields = {f: F.col(f) for f in V.PROFILE_FIELDS}
    assessed = rules.assess(find_candidates(profiles, chunks, documents, embed, **options), profiles)
    open_ = profiles.select(
        "query_id", F.col("conflicts") if "conflicts" in profiles.columns else F.lit(0).alias("conflicts"),
        rules.missing_questions(fields).alias("questions")
    )
    lists = rules.checklists(open_, rules.checklist_items(assessed), (F.size("questions") == 0) & (F.col("conflicts") == 0))
    return assessed, open_, lists.select("query_id", F.coalesce("items", F.array()).alias("items"))
