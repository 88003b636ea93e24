from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common


@pytest.mark.parametrize(("share", "least"), [(0.0, 0), (0.1, 5), (0.9, 10**9)])
def test_hot_keys_meet_either_way(spark, monkeypatch, share, least):
    """All keys by broadcast, some, or none: the same rows."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    monkeypatch.setattr(common, "HOT_ROWS", least)
    rows = spark.createDataFrame([(None if i % 9 == 0 else i % 7 if i % 2 else 3, i) for i in range(300)], "k long, v long")
    counted = rows.where("k is not null and k <> 5").groupBy("k").agg(F.count("*").alias("members"), F.min("v").alias("low"))
    got = Counter(tuple(r) for r in common.join_counted(rows, counted, ["k"]).collect())
    assert got == Counter(tuple(r) for r in rows.join(counted.drop("members"), "k").collect())


def test_stored_rows_come_back(spark):
    df = spark.createDataFrame([(1, [b"a"]), (None, None)], "a long, b array<binary>")
    again = common.stored(df)
    assert again.schema == df.schema and Counter(map(repr, again.collect())) == Counter(map(repr, df.collect()))
    assert common.stored(df.limit(0)).count() == 0


def test_nothing_hot_nothing_broadcast(spark):
    rows = spark.range(300).selectExpr("id % 50 as k", "id as v")
    counted = rows.groupBy("k").agg(F.count("*").alias("members"), F.min("v").alias("low"))
    joined = common.join_counted(rows, counted, ["k"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.where("v % 50 = low").count() == 300
