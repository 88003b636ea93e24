"""What the plans look like: columns and filters reach the scan, and no Python runs for the engine's own queries."""

import os

import pytest

from __spark_entry__ import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_columns_asked_for_are_read(spark):
    assert "ReadSchema: struct<p_type:string>" in plan(QUERIES["facet_distinct"](spark, SF))
    text = plan(QUERIES["children_counts"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "l_extendedprice" not in text


def test_filters_reach_the_scan(spark):
    assert "EqualTo(p_type,ECONOMY)" in plan(QUERIES["catalogue_search"](spark, SF))
    assert "GreaterThanOrEqual(l_quantity,50.0)" in plan(QUERIES["labs_search"](spark, SF))


def test_limits_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["history_recent"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["last_n_turns"](spark, SF))


@pytest.mark.parametrize("name", ["hybrid_rerank", "checklist", "chunk_documents", "profile_fold", "off_corpus_flag", "ladder_search", "prompt_block"])
def test_no_python_runs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(x in text for x in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"))


def test_only_words_asked_for_leave_their_rows(spark):
    """BM25 over tokenised rows filters a row's tokens before it spreads them."""
    from quillspark.operators import search
    from quillspark.plans.queries import _all_words
    from quillspark.plans.tables import table

    text = plan(search.bm25(search.tokenised(table(spark, SF, "documents")), _all_words(spark, SF, 3), 10))
    assert "explode(filter(toks" in text and "explode(toks" not in text


def test_searches_read_the_index(spark):
    """BM25 over the stored index reads the partitions of its words, and no text."""
    text = plan(QUERIES["bm25_topk_and"](spark, SF))
    assert "documents.parquet" not in text and "index-" in text
    assert "bucket#" in text.split("PartitionFilters: [")[1].split("]")[0] and "In(word, [" in text
