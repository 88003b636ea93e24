"""The fold over events against a plain loop, with documents that span tasks and blocks."""

import random

import pytest

from quillspark.operators import lifecycle

EVENTS = "doc string, ts int, event_id long, status string"
NAMES = [*lifecycle.STEPS, "unknown", None]


def made_up(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3, 4, 5, 6]), i, rng.choice(NAMES)) for i in range(n)]
    chain = list(lifecycle.STEPS)[:5]
    return rows + [(f"d{i}", j, 1000 + j, s) for i in range(20) for j, s in enumerate(chain[1 : 1 + i % 5] + ["failed"] * (i % 2))]


def plain(rows, steps=lifecycle.STEPS):
    state, out = {}, []
    for doc, ts, i, status in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or "")):
        before = state.get(doc, "uploaded")
        after = status if status in steps.get(before, []) else before
        state[doc] = after
        out.append((doc, ts, i, status, before, after, after != before))
    return out


@pytest.mark.parametrize("block", [3, 128])
def test_against_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(lifecycle, "BLOCK", block)
    rows = made_up(1)
    found = lifecycle.transitions(spark.createDataFrame(rows, EVENTS).repartition(5), "doc", ["ts", "event_id"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
    last = {r.doc: (r.state, r.n_accepted, r.n_illegal) for r in lifecycle.final_states(found, "doc", ["ts", "event_id"]).collect()}
    want = {}
    for doc, *_, after, ok in plain(rows):
        n = want.get(doc, (None, 0, 0))
        want[doc] = (after, n[1] + ok, n[2] + (not ok))
    assert last == want


def test_one_document_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cycle = {"a": ["b"], "b": ["c"], "c": ["a"]}
        rng = random.Random(2)
        rows = [("one", i, i, rng.choice("abc")) for i in range(3000)]
        found = lifecycle.transitions(spark.createDataFrame(rows, EVENTS), "doc", ["ts", "event_id"], steps=cycle, start="a").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, want = "a", []
    for doc, ts, i, status in rows:
        after = status if status in cycle[state] else state
        want.append((doc, ts, i, status, state, after, after != state))
        state = after
    assert sorted(map(tuple, found)) == want


def test_nothing(spark):
    assert lifecycle.transitions(spark.createDataFrame([], EVENTS), "doc", ["ts"]).count() == 0
