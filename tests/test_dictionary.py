"""Patterns in texts against plain containment."""

import random

import pytest

from quillspark.operators import dictionary


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé İß") for _ in range(rng.randint(0, 9)))
    texts = [(i, "".join(word() for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "İstanbul ẞ")]
    patterns = [(f"p{i}", rng.choice([word(), (rng.choice(texts)[1] or "")[2:9], (rng.choice(texts)[1] or "")[:2].upper()])) for i in range(150)]
    return texts, patterns + [("null", None), ("same", patterns[0][1]), ("long", "x" * 400)]


def plain(spark, texts, patterns):
    low = lambda rows: {k: v for k, v in spark.createDataFrame(rows, "k string, v string").selectExpr("k", "lower(v)").collect() if v}
    t, p = low([(str(k), v) for k, v in texts]), low(patterns)
    return {(i, int(k)) for i, x in p.items() for k, v in t.items() if x in v}


@pytest.mark.parametrize("most", [0, 200_000])
def test_occurrences(spark, monkeypatch, most):
    monkeypatch.setattr(dictionary, "BROADCAST_PATTERNS", most)
    texts, patterns = made_up(1)
    rows = spark.createDataFrame([*texts, texts[0]], "key long, text string").repartition(3)
    got = dictionary.occurrences(rows, spark.createDataFrame(patterns, "pattern_id string, pattern string")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain(spark, texts, patterns) and got


def test_no_pairs_without_a_gram(spark):
    texts, patterns = made_up(2)
    df = dictionary.occurrences(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(patterns, "pattern_id string, pattern string"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_and_blank(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, None)], "key long, text string")
    none = spark.createDataFrame([], "pattern_id string, pattern string")
    for patterns in (none, spark.createDataFrame([("a", ""), ("b", None)], none.schema)):
        found = dictionary.occurrences(texts, patterns)
        assert found.columns == ["pattern_id", "key"] and found.count() == 0
    assert dictionary.occurrences(texts.limit(0), spark.createDataFrame([("a", "b")], none.schema)).count() == 0


def test_any_column(spark):
    rows = spark.createDataFrame([(1, "Steel pipe", "IS 302"), (2, "Pipe", None), (3, None, "steel"), (4, "st", "eel")], "id long, title string, number string")
    asked = spark.createDataFrame([("q", "STEEL"), ("r", "is 3"), ("s", " "), ("t", "")], "query_id string, words string")
    got = {tuple(r) for r in dictionary.found_in_any(rows, asked, "id", ["title", "number"]).collect()}
    assert got == {("q", 1), ("q", 3), ("r", 1), ("s", 1)}


def test_categories(spark):
    texts = spark.createDataFrame([(1, "Testing and MARKING"), (2, "mark"), (3, "none")], "key long, text string")
    words = spark.createDataFrame([("T", "test"), ("T", "testing"), ("M", "mark"), ("X", "zzz"), ("B", "mark")], "category string, keyword string")
    assert {tuple(r) for r in dictionary.categories(texts, words).collect()} == {(1, "T"), (1, "M"), (1, "B"), (2, "M"), (2, "B")}


def test_long_text(spark):
    texts = spark.createDataFrame([(1, "ab " * 300_000 + "needle"), (2, "nee dle")], "key long, text string")
    assert [r.key for r in dictionary.occurrences(texts, spark.createDataFrame([("n", "Needle")], "pattern_id string, pattern string")).collect()] == [1]


def test_grams_are_found_by_one_pass_of_a_pattern(spark):
    """Runs over line ends and letters of two units too, without a function for each letter."""
    rows = [(1, "a\nb😀cc"), (2, "ab"), (3, ""), (4, "aaaa")]
    df = dictionary.grams(spark.createDataFrame(rows, "key long, t string"), "t", [1, 3], ["key"])
    text = df._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" in text and "transform(" not in text
    got, want = {(r.key, r.gram) for r in df.collect()}, {(k, t[i : i + n]) for k, t in rows for n in (1, 3) for i in range(len(t) - n + 1)}
    assert want <= got and {g for g in got - want if "😀" not in rows[g[0] - 1][1]} == set()
    found = dictionary.occurrences(spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame([("x", "B😀C"), ("y", "\nb"), ("z", "😀")], "pattern_id string, pattern string"))
    assert {tuple(r) for r in found.collect()} == {("x", 1), ("y", 1), ("z", 1)}
