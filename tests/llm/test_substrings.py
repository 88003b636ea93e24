import hashlib
from collections import Counter

import pytest

from quillspark.llm import substrings
from tests.llm.conftest import corpus


def brute(rows, window=13):
    split = [(t or "").encode().split() for _, t, *_ in rows]
    least = {}
    for (doc, *_), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            key, own = tuple(words[i : i + window]), substrings.LAST_ID if doc is None else doc
            least[key] = min(least.get(key, own), own)
    out = Counter()
    for (doc, *_), words in zip(rows, split, strict=True):
        own, hit = substrings.LAST_ID if doc is None else doc, set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < own:
                hit |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in hit)
        out[doc, len(words), len(hit), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group_rows", [substrings.GROUP_ROWS, 3])
def test_against_brute_force(docs, monkeypatch, group_rows):
    monkeypatch.setattr(substrings, "GROUP_ROWS", group_rows)
    rows, _ = corpus()
    assert Counter(tuple(r) for r in substrings.op8(docs).collect()) == brute(rows)


def test_small_batches(spark, docs):
    """Runs of equal windows that go over several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows, _ = corpus()
        assert Counter(tuple(r) for r in substrings.op8(docs).collect()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(odd, none, spark):
    rows, _ = corpus()
    assert Counter(tuple(r) for r in substrings.op8(odd).collect()) == brute(rows)
    assert substrings.op8(none).count() == 0
    same_id = [
        (1, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m n o"), (2, "x a b c d e f g h i j k l m"),
        (3, "a b c d e f g h i j k l m n"), (4, " ".join(["q"] * 40)), (5, " ".join(["q"] * 14))
    ]
    got = substrings.op8(spark.createDataFrame(same_id, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute(same_id)
