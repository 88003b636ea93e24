"""Retrieval for batches of queries: vector top-k, BM25 top-k, and whether a question is off the corpus.

A batch is a table of queries; every rank and every normalisation is within its query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as X
from quillspark.operators import matching, postings

#: Rows of a query table up to which it is broadcast to the corpus; a larger one meets it in tiles of TILE queries and TILE vectors.
BROADCAST_QUERIES, TILE = 2_000, 20_000
#: Queries, and vectors, of a tile that are compared at once: what a task holds beyond its rows doesn't grow with the tile.
BLOCK = 512
#: Words (some 40 bytes each) up to which their table is broadcast.
BROADCAST_WORDS = 200_000


def _few(names: DataFrame) -> DataFrame:
    """names, broadcast up to BROADCAST_WORDS: so that vectors stay in as many tasks as they come in, however small they are beside the work on them."""
    return F.broadcast(names) if names.count() <= BROADCAST_WORDS else names


def vector_top_k(
    queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", within: DataFrame | None = None, parents: DataFrame | None = None,
    parent_key: str = "document_id", allowed: DataFrame | None = None, model: str | None = None, model_column: str = "embedding_model"
) -> DataFrame:
    """query_id, rank, key, score: the k vectors of most cosine, by score and then key.

    queries: query_id, query_vector. vectors: key, embedding. within: keys that may be found (an empty table finds
    nothing). parents: existing parents; vectors without one are left out. allowed: query_id, parent_key: the parents
    each query may find; queries that it does not name find nothing. model: only vectors of this embedding model are
    candidates. Null and zero vectors are never found. A zero query vector, and a candidate of another dimension than the query's, is an error.
    """
    if model is not None:
        vectors = vectors.where(F.col(model_column) == model)
    if within is not None:
        vectors = vectors.join(within.select(key).distinct(), key, "left_semi")
    if parents is not None:
        vectors = vectors.join(_few(parents.select(parent_key).distinct()), parent_key, "left_semi")
    columns = [key] if allowed is None or parent_key == key else [key, parent_key]
    base = vectors.select(*columns, "embedding", X.squared_norm(F.col("embedding")).alias("norm")).where("norm > 0")
    asked = queries.select("query_id", "query_vector", X.squared_norm(F.col("query_vector")).alias("query_norm"))
    few = asked.count() <= BROADCAST_QUERIES
    if allowed is None and not few:
        scored = _tile_scores(base, asked, k, key)
    else:
        small = F.broadcast(asked) if few else asked
        pairs = base.join(small) if allowed is None else base.join(_few(allowed.select("query_id", parent_key).distinct()), parent_key).join(small, "query_id")
        score = X.checked_cosine(F.col("embedding"), F.col("query_vector"), F.col("norm"), F.col("query_norm"))
        scored = pairs.select("query_id", key, score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _tile_scores(base: DataFrame, asked: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, key, score: of each tile (a block of queries and a block of vectors) the k best of each of its queries.

    Vectors are read once and sent to as many tiles as there are blocks of queries. Sums run over the dimensions in their
    order, as they do elsewhere, so that equal vectors have equal scores in every tile.
    """
    across, down = -(-base.count() // TILE) or 1, -(-asked.count() // TILE)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    vectors = base.select(F.col(key).alias("key"), "embedding", "norm", block(key, across).alias("across"), every(down).alias("down"))
    queries = asked.select("query_id", "query_vector", "query_norm", block("query_id", down).alias("down"), every(across).alias("across"))
    kinds = {f.name: f.dataType.simpleString() for f in (*vectors.schema, *queries.schema)}

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("key")  # of equal scores the smaller key stays first
        v, q = X.matrix(left["embedding"]), X.matrix(right["query_vector"])
        norm, query_norm = left["norm"].to_numpy(), right["query_norm"].to_numpy()
        if not (len(q) and len(v)):
            return pa.table({"query_id": right["query_id"].slice(0, 0), "key": left["key"].slice(0, 0), "score": pa.array([], pa.float64())})
        if (query_norm == 0).any():
            raise ValueError(X.ZERO_QUERY)
        if v.shape[1] != q.shape[1]:
            raise ValueError(X.OTHER_DIMENSION)
        found = []
        for start in range(0, len(q), BLOCK):
            own, own_norm = q[start : start + BLOCK], query_norm[start : start + BLOCK, None]
            top, place = np.empty((len(own), 0)), np.empty((len(own), 0), np.int64)
            for at in range(0, len(v), BLOCK):
                part = v[at : at + BLOCK]
                dots = np.zeros((len(own), len(part)))
                for d in range(v.shape[1]):
                    dots += own[:, d : d + 1] * part[:, d]
                scores = np.hstack([top, dots / np.sqrt(norm[at : at + BLOCK] * own_norm)])
                places = np.hstack([place, np.broadcast_to(np.arange(at, at + len(part)), dots.shape)])
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                top, place = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
            found.append((top, place))
        top, place = (np.vstack(x) for x in zip(*found, strict=True))
        rows = np.repeat(np.arange(len(q)), top.shape[1])
        return pa.table({"query_id": right["query_id"].take(pa.array(rows)), "key": left["key"].take(pa.array(place.ravel())), "score": top.ravel()})

    tiles = vectors.groupBy("across", "down").cogroup(queries.groupBy("across", "down"))
    return tiles.applyInArrow(best, f"query_id {kinds['query_id']}, key {kinds['key']}, score double").withColumnRenamed("key", key)


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toks, dl; a null text has no tokens. Where many searches follow, an index (`postings.build`) saves them the reading."""
    return postings.tokenised(docs, key, text).withColumnRenamed("key", key)


def _places(corpus: DataFrame, asked: DataFrame, key: str, longest: int, few: bool) -> DataFrame:
    """key, dl, word and (from two words on) run: the places of the first words asked for, each with the words from there on.

    Only rows with a phrase's first word can hold it: an equality join on words, not a scan per phrase. Few phrases' words
    go into the expression, so no other place leaves its row; many are met by a join that drops the rest before any shuffle
    carries a run.
    """
    first = asked.select("word").distinct()
    known = [r["word"] for r in first.collect()] if few else None
    wanted = (lambda w: w.isin(known)) if few else lambda w: F.lit(True)
    run = lambda i: F.slice("toks", i + 1, F.lit(longest))
    if longest < 2:
        places = corpus.select(key, "dl", F.explode(F.filter("toks", wanted)).alias("word"))
    else:
        at = F.array_compact(F.transform("toks", lambda w, i: F.when(wanted(w), i)))
        places = corpus.select(
            key, "dl", F.explode(F.transform(at, lambda i: F.struct(F.get("toks", i).alias("word"), run(i).alias("run")))).alias("r")
        ).select(key, "dl", "r.word", "r.run")
    return places if few else places.join(F.broadcast(first) if first.count() <= BROADCAST_WORDS else first, "word", "left_semi")


def _held(corpus: DataFrame, asked: DataFrame, key: str, longest: int, few: bool) -> DataFrame:
    """query_id, phrase_no, key, dl, f of a tokenised corpus."""
    places = _places(corpus, asked, key, longest, few).join(F.broadcast(asked) if few else asked, "word")
    places = places if longest < 2 else places.where(F.slice("run", F.lit(1), F.size("words")) == F.col("words"))
    return places.groupBy("query_id", "phrase_no", key, "dl").agg(F.count("*").alias("f"))


def bm25(
    corpus: DataFrame | postings.Index, phrases: DataFrame, k: int, key: str = "doc_id", within: DataFrame | None = None,
    k1: float = postings.K1, b: float = postings.B
) -> DataFrame:
    """query_id, rank, key, bm25 (negative, less is better) of the k best rows that have every phrase of the query.

    corpus: as from tokenised, or an index, of which only the words asked for are read. phrases: query_id, phrase_no, words (an
    array; several words must follow each other). within: keys that may be found; the statistics stay those of the
    whole corpus. A query without phrases finds nothing.
    """
    asked = phrases.where(F.size("words") > 0).select("query_id", "phrase_no", "words", F.get("words", F.lit(0)).alias("word"))
    longest, n = asked.agg(F.coalesce(F.max(F.size("words")), F.lit(0)), F.count("*")).first()
    few = n <= BROADCAST_QUERIES
    small = F.broadcast if few else lambda df: df
    if isinstance(corpus, postings.Index):
        stats, held = corpus.stats(), postings.held(corpus, asked.drop("word")).withColumnRenamed("key", key)
    else:
        stats, held = corpus.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), _held(corpus, asked, key, longest, few)
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("n_phrases"))
    df = held.groupBy("query_id", "phrase_no").agg(F.count("*").alias("df"))
    rows = held.join(small(df), ["query_id", "phrase_no"]).join(F.broadcast(stats))
    part = postings.idf(F.col("n"), F.col("df")) * postings.weight(F.col("f"), F.col("dl"), F.col("avgdl"), k1, b)
    scored = rows.groupBy("query_id", key).agg((-F.sum(part)).alias("bm25"), F.count("*").alias("has")).join(small(wanted), "query_id").where("has = n_phrases")
    if within is not None:
        scored = scored.join(within.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.round("bm25", 9), key)  # sums of equal parts may differ in their last bits
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "bm25")


#: Bare words with implicit AND; an underscore makes a phrase; anything else is a syntax error in the query language.
BARE_TERM = r"(?U)^(?=\s*[\w\u0080-\uffff])[\w\u0080-\uffff\s]+$"


def term_phrases(terms: DataFrame, quote: bool = False) -> DataFrame:
    """query_id, term_pos, phrase_no, words of terms (query_id, term_pos, term).

    A term that is not made of bare words is malformed and finds nothing; with quote it is searched as one phrase instead.
    """
    if quote:
        return terms.select("query_id", "term_pos", F.lit(0).alias("phrase_no"), T.tokens(F.col("term")).alias("words"))
    operators = F.col("term").rlike(r"(?:^|\s)(?:AND|OR|NOT)(?:\s|$)|NEAR\(")
    good = terms.where(F.col("term").rlike(BARE_TERM) & ~operators)
    words = F.filter(F.split(T.strip(F.col("term")), r"(?U)\s+"), lambda w: w != "")
    return good.select("query_id", "term_pos", F.posexplode(words).alias("phrase_no", "word")).select(
        "query_id", "term_pos", "phrase_no", T.tokens(F.col("word")).alias("words")
    )


def best_term(corpus: DataFrame | postings.Index, terms: DataFrame, k: int, key: str = "doc_id", quote: bool = False) -> DataFrame:
    """query_id, key, bm25, term: for each row found by any of a query's terms (k rows a term), its best term; ties go to the earlier one.

    corpus: an index, or as from tokenised. A term is a text of the search language; a malformed one finds nothing
    (`matching.malformed` says why), or with quote each is searched as one phrase.
    """
    index = corpus if isinstance(corpus, postings.Index) else postings.Unstored(corpus, key)
    one = F.struct("query_id", "term_pos").alias("query_id")
    text = F.concat(F.lit('"'), F.replace(F.col("term"), F.lit('"'), F.lit('""')), F.lit('"')) if quote else F.col("term")
    found = matching.search(index, terms.select(one, text.alias("query")), k, key)
    found = found.select(
        F.col("query_id.query_id").alias("query_id"), F.col("query_id.term_pos").alias("term_pos"), key, "bm25"
    ).join(terms, ["query_id", "term_pos"])
    return found.groupBy("query_id", key).agg(F.min(F.struct("bm25", "term_pos", "term")).alias("m")).select("query_id", key, "m.bm25", "m.term")


def off_corpus(questions: DataFrame, evidence: DataFrame, least: float | None = None) -> DataFrame:
    """query_id, n_words, grounding, off_corpus. questions: query_id, text. evidence: query_id, text of each chunk found."""
    least = T.V.LEAST_GROUNDING if least is None else least
    words = questions.select("query_id", T.content_words(F.col("text")).alias("words"))
    asked = F.broadcast(words) if words.count() <= BROADCAST_QUERIES else words
    # of each chunk only the question's own words leave the row, so nothing grows with the evidence's text
    said = evidence.select("query_id", T.all_stems(F.col("text")).alias("stems")).join(asked, "query_id").select(
        "query_id", F.array_intersect("words", "stems").alias("said")
    )
    met = said.select("query_id", F.explode("said").alias("word")).distinct().groupBy("query_id").agg(F.count("*").alias("n_met"))
    chunks = evidence.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    rows = words.join(met, "query_id", "left").join(chunks, "query_id", "left")
    n, grounding = F.size("words"), F.when(F.size("words") > 0, F.coalesce("n_met", F.lit(0)) / F.size("words"))
    return rows.select(
        "query_id", n.alias("n_words"), grounding.alias("grounding"),
        F.coalesce((F.col("n_chunks") > 0) & (grounding < least), F.lit(False)).alias("off_corpus")
    )


def evaluate(ranked: DataFrame, expected: DataFrame, key: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of cases whose expected row is among the first k. expected: query_id, key."""
    rows = expected.join(ranked.select("query_id", key, "rank"), ["query_id", key], "left")
    return rows.agg(F.count("*").alias("cases"), *(F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in ks))
