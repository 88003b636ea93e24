"""The batch embedder: loads, batches, errors; guards of retrieval."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import embedding
from quillspark.plans import discovery


def counting(folder, dimension=384, result=None):
    def load():
        with open(os.path.join(folder, f"load-{os.getpid()}"), "a") as out:
            out.write("x")
        encode = embedding.hashed_grams(dimension)()

        def run(texts):
            with open(os.path.join(folder, f"sizes-{os.getpid()}"), "a") as out:
                out.write(f"{len(texts)}\n")
            return encode(texts) if result is None else result(texts)

        return run

    return load


def plain(text, dimension=384):
    out = [0.0] * dimension
    for i in range(len(text) - 2):
        a, b, c = map(ord, text[i : i + 3])
        out[((a * 31 + b) * 31 + c) % dimension] += 1
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def test_vectors(spark):
    texts = ["", None, "ab", "abc", "Über 😀 x", "word " * 2000]
    embed = embedding.hashed_gram_embedder()
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed(F.col("t")).alias("v")).collect():
        assert np.allclose(r.v, plain(r.t or ""), atol=1e-6) and len(r.v) == embed.dimension


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    embed = embedding.Embedder("counted", 384, counting(str(tmp_path)), batch=50)
    df = spark.range(0, 4000, 1, 16).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    for _ in range(3):
        assert df.select(F.size(embed(F.col("t"))).alias("n")).agg(F.min("n")).first()[0] == 384
    loads = [p.read_text() for p in tmp_path.glob("load-*")]
    sizes = [int(n) for p in tmp_path.glob("sizes-*") for n in p.read_text().split()]
    assert loads and all(x == "x" for x in loads) and len(loads) <= 16
    assert sum(sizes) == 12_000 and max(sizes) == 50
    assert spark.createDataFrame([], "t string").select(embed(F.col("t"))).count() == 0


@pytest.mark.parametrize("result", [lambda t: np.zeros((len(t), 3)), lambda t: np.zeros((len(t) + 1, 384)), lambda t: np.full((len(t), 384), np.nan)])
def test_bad_models_are_errors(spark, tmp_path, result):
    embed = embedding.Embedder("bad", 384, counting(str(tmp_path), result=result))
    with pytest.raises(Exception, match="bad gave"):
        spark.createDataFrame([("a",)], "t string").select(embed(F.col("t"))).collect()


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame([(f"D{i}", 1, f"1 SCOPE\nThis covers {w}.") for i, w in enumerate(["water heaters", "steel pipes", "ceiling fans"])], "document_id string, page_number int, text string")
    documents = spark.createDataFrame([(f"D{i}", f"d{i}.pdf", "OTHER", f"S{i % 2}") for i in range(3)], "document_id string, document_name string, document_type string, standard_id string")
    return pages, documents


def test_retrieval_compares_one_model(spark, corpus):
    pages, documents = corpus
    embed, other = embedding.hashed_gram_embedder(), embedding.hashed_gram_embedder(64, 2)
    chunks = discovery.index(pages, embed)
    asked = spark.createDataFrame([(1, "This covers steel pipes"), (2, "This covers ceiling fans")], "query_id int, text string")
    both = chunks.unionByName(discovery.index(pages, other))  # vectors of two dimensions in one table
    for model, table in ((embed, chunks), (embed, both), (other, both)):
        top = discovery.retrieve(asked, table, documents, model).where("rank = 1").collect()
        assert {(r.query_id, r.document_id) for r in top} == {(1, "D1"), (2, "D2")}
    assert discovery.retrieve(asked, chunks, documents, other).count() == 0


def test_an_unknown_document_is_an_error(spark, corpus):
    pages, documents = corpus
    chunks = discovery.index(pages)
    kind = "query_id int, text string, document_id string, standard_id string"
    ask = lambda *rows: discovery.retrieve(spark.createDataFrame(list(rows), kind), chunks, documents).select("query_id", "document_id").collect()
    with pytest.raises(Exception, match="there is no document D9"):
        ask((1, "x", "D9", None), (2, "y", "D1", None))
    assert {tuple(r) for r in ask((1, "x", "D1", None), (2, "y", None, "S9"), (3, "z", None, "S1"))} == {(1, "D1"), (3, "D1")}
    with pytest.raises(Exception, match="exclude each other"):
        ask((1, "x", "D1", "S1"))


def test_the_hash_embedder_adds_up_a_text_once(spark):
    """The sum of code points is taken outside of what runs once a dimension."""
    df = spark.createDataFrame([("ab",), ("",), (None,), ("é😀",)], "text string").select(T.hash_embedding(F.col("text")).alias("v"))
    assert "transform(array(aggregate(" in df._jdf.queryExecution().analyzed().toString().replace("cast(", "")
    total = lambda text: sum(map(ord, text))
    assert [r.v for r in df.collect()] == [
        [None] * 8 if text is None else [(total(text) + i) % 100 / 100 for i in range(8)] for text in ("ab", "", None, "é😀")
    ]
