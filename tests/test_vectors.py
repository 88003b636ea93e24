"""Vector search: tiles against the broadcast join, errors and guards."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search

VECTORS, ASKED = "vec_id long, embedding array<float>, embedding_model string, document_id long", "query_id string, query_vector array<float>"


def made_up(n=90, dim=7, seed=1):
    rng = random.Random(seed)
    vector = lambda: [float(rng.randint(-2, 2)) / 3 for _ in range(dim)]
    rows = [(i, vector(), "one", i % 9) for i in range(n)]
    rows += [(n + i, rows[i * 3][1], "one", i) for i in range(20)] + [(500, [0.0] * dim, "one", 1), (501, None, "one", 1)]
    return rows, [(f"q{i}", [x + 0.01 for x in vector()]) for i in range(30)]


@pytest.fixture(scope="module")
def tables(spark):
    rows, asked = made_up()
    return spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(asked, ASKED).repartition(2)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("tile", [1_000, 11])
def test_tiles(tables, monkeypatch, tile):
    """The same rows, ranks and scores to the last bit, ties included."""
    vectors, asked = tables
    want = rows_of(search.vector_top_k(asked, vectors, 5))
    parents = vectors.select("document_id").where("document_id < 4")
    some = rows_of(search.vector_top_k(asked, vectors, 5, within=vectors.where("vec_id % 2 = 0"), parents=parents))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(search, "TILE", tile)
    assert rows_of(search.vector_top_k(asked, vectors, 5)) == want and len(want) == 150
    assert rows_of(search.vector_top_k(asked, vectors, 5, within=vectors.where("vec_id % 2 = 0"), parents=parents)) == some
    assert search.vector_top_k(asked, vectors.where("false"), 5).count() == 0 and search.vector_top_k(asked.where("false"), vectors, 5).count() == 0


def test_vectors_are_read_once(spark, tables, tmp_path, monkeypatch):
    vectors, asked = tables
    for name, df in (("v", vectors), ("q", asked)):
        df.write.parquet(str(tmp_path / name))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(search, "TILE", 4)  # some eight blocks of queries
    found = search.vector_top_k(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "v")), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [0, 2_000])
def test_errors(spark, tables, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
    vectors, _ = tables
    ask = lambda v: spark.createDataFrame([("q", v)], ASKED)
    with pytest.raises(Exception, match="zero vector"):
        search.vector_top_k(ask([0.0] * 7), vectors, 3).collect()
    with pytest.raises(Exception, match="another dimension"):
        search.vector_top_k(ask([1.0, 2.0]), vectors, 3).collect()
    mixed = vectors.where("vec_id < 3").withColumn("embedding", F.when(F.col("vec_id") == 1, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="another dimension"):
        search.vector_top_k(ask([1.0] * 7), mixed, 3).collect()
    # without candidates there is nothing to compare with
    assert search.vector_top_k(ask([0.0] * 7), vectors.where("false"), 3).count() == 0


@pytest.mark.parametrize("most", [0, 2_000])
def test_other_models_are_no_candidates(spark, tables, monkeypatch, most):
    monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
    vectors, asked = tables
    other = spark.createDataFrame([(900, [1.0, 2.0], "two", 1), (901, [9.0] * 7, None, 1)], VECTORS)
    both = vectors.unionByName(other)
    assert rows_of(search.vector_top_k(asked, both, 4, model="one")) == rows_of(search.vector_top_k(asked, vectors, 4))
    assert search.vector_top_k(asked, both, 4, model="three").count() == 0
    two = spark.createDataFrame([("q", [1.0, 1.0])], ASKED)
    assert [r.vec_id for r in search.vector_top_k(two, both, 4, model="two").collect()] == [900]


def test_allowed_with_many_queries(spark, tables, monkeypatch):
    vectors, asked = tables
    allowed = asked.select("query_id", (F.abs(F.hash("query_id")) % 9).cast("long").alias("document_id"))
    want = rows_of(search.vector_top_k(asked, vectors, 3, allowed=allowed))
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert rows_of(search.vector_top_k(asked, vectors, 3, allowed=allowed)) == want and want


def test_tiles_are_compared_in_blocks(spark, monkeypatch):
    """Blocks of queries and of vectors, of which some are not full, find what one block finds."""
    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) + 0.5 for d in range(4)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 11").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    found = lambda: sorted(tuple(r) for r in search.vector_top_k(asked, vectors, 5).collect())
    want = found()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1)
    for block in (3, 512):
        monkeypatch.setattr(search, "BLOCK", block)
        got = found()
        assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))
