import hashlib
import re
from collections import Counter

from quillspark.llm import decontaminate
from tests.llm.conftest import corpus

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, items, window=10):
    spots = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            spots.setdefault(tuple(words[i : i + n]), set()).add(item or "")
    out = Counter()
    for doc, text, *_ in rows:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in spots}:
            for i in range(len(words) - n + 1):
                if who := spots.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= who
        out[doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


ITEMS = [("b1", "W1 w2"), ("b2", ""), ("b3", None), ("b4", "one"), ("b5", "over-the; Moon"), ("b5", "w5, W6! w7"), (None, "no id here")]


def items_of(rows, passage):
    long = [(f"p{i}", passage[i * 9 :]) for i in range(4)]
    return ITEMS + long + [("t", rows[7][1]), ("t2", rows[7][1]), ("rep", "the " * 30)]


def test_against_brute_force(spark, docs, odd):
    rows, passage = corpus()
    items = items_of(rows, passage)
    table = spark.createDataFrame(items, "item_id string, text string")
    want = brute(rows, items)
    assert Counter(tuple(r) for r in decontaminate.op4(docs, table).collect()) == want
    clean = sorted(str(k[0]) for k, n in want.items() for _ in range(n) if not k[5])
    assert sorted(str(r.doc_id) for r in decontaminate.clean_documents(docs, table).collect()) == clean
    assert decontaminate.clean_documents(odd, table).count() == len(clean)


def test_shuffled_join_and_small_bitmap(spark, docs, monkeypatch):
    """Beyond the broadcast's bound, and with a bitmap that passes nearly all, results are the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 64)
    rows, passage = corpus()
    items = items_of(rows, passage)
    got = decontaminate.op4(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, items)


def test_empty(spark, docs, none):
    no_items = spark.createDataFrame([], "item_id string, text string")
    got = decontaminate.op4(docs, no_items)
    assert got.where("contaminated or n_hit > 0").count() == 0 and got.count() == docs.count()
    assert decontaminate.op4(none, spark.createDataFrame(ITEMS, "item_id string, text string")).count() == 0
