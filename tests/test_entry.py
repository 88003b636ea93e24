"""The driver's contract, and the queries that have no SQL."""

import hashlib
import os

import pytest

import __spark_entry__ as entry
from __spark_entry__ import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


@here
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con.execute(f"CREATE TABLE want AS {ORACLES[name]}")
    assert sorted(r[0] for r in con.execute("DESCRIBE want").fetchall()) == columns
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM want").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


@here
def test_chunk_documents(spark):
    from tests.test_operators import chunk_page

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r.document_id, r.chunk_index): (r.chars, r.sha256) for r in QUERIES["chunk_documents"](spark, SF).collect()}
    want = {}
    for r in rows:
        for i, (_, text) in enumerate(chunk_page((r.text or "").replace("\n", "\n\n"))):
            text = text.replace("\n\n", "\n")
            want[r.doc_id, i] = (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert set(k[0] for k in got) == set(k[0] for k in want) and len(got) <= len(want)
