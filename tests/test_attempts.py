"""Attempts against doing one search after another."""

import random

import pytest

from quillspark.operators import attempts

RESULTS = "query_id long, position int, identifier string, content_hash string, refused boolean, completed boolean"


def one_by_one(results, known):
    known, out = set(known), set()
    for q in sorted({r[0] for r in results}):
        over = False
        for _, position, identifier, content, refused, completed in sorted((r for r in results if r[0] == q), key=lambda r: (r[1], r[2]))[:3]:
            if over:
                outcome = "not tried"
            elif content is None:
                outcome = "unreachable"
            elif refused:
                outcome = "refused"
            elif content in known:
                outcome = "duplicate"
            else:
                known.add(content)
                outcome = "ingested" if completed else "incomplete"
            over = over or outcome in ("duplicate", "ingested")
            out.add((q, position, identifier, content, outcome))
    return out


@pytest.mark.parametrize("seed, contents", [(1, 200), (2, 25), (3, 6)])
def test_against_one_by_one(spark, seed, contents):
    rng = random.Random(seed)
    rows = [
        (q, i, f"i{q}-{i}", rng.choice([None, *(f"c{rng.randrange(contents)}" for _ in range(5))]), rng.random() < 0.1 or None, rng.random() < 0.6)
        for q in range(60) for i in range(rng.randint(1, 5))
    ]
    known = ["c0", "c3"]
    found = attempts.attempts(spark.createDataFrame(rows, RESULTS).repartition(4), spark.createDataFrame([(c,) for c in [*known, "c3", None]], "content_hash string"))
    assert {tuple(r) for r in found.collect()} == one_by_one(rows, known)
    new = attempts.new_documents(found)
    assert new.count() == sum(r[4] == "ingested" for r in one_by_one(rows, known))


def test_a_chain_of_searches(spark):
    """Each search waits for the one before it: what it takes in depends on what that one left."""
    rows = [(q, 0, "a", f"c{q}", False, True) for q in range(1)] + [(q, i, f"x{i}", f"c{q - 1 + i}", False, False) for q in range(1, 12) for i in (0, 1)]
    found = attempts.attempts(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([], "content_hash string"))
    assert {tuple(r) for r in found.collect()} == one_by_one(rows, [])


def test_no_results(spark):
    none = spark.createDataFrame([], RESULTS)
    assert attempts.attempts(none, none.select("content_hash")).count() == 0


def test_rounds_are_bounded(spark):
    rows = [(q, i, f"x{i}", f"c{q + i}", False, False) for q in range(30) for i in (0, 1)]
    with pytest.raises(RuntimeError, match="still change"):
        attempts.attempts(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([], "content_hash string"), rounds=1)
