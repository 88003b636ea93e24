import math
from collections import Counter, defaultdict

import pytest

from quillspark.llm import mixing
from tests.llm.conftest import corpus


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """By repeated resharing of what exceeds the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check(df, rows):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    want = brute_targets(sizes)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode().split())) for d, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert {k for k in taken} == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (_, target), words in taken.items():
        assert abs(words - target) <= max(3, 0.01 * target)


def test_targets_and_taken(docs, odd):
    rows, _ = corpus()
    check(docs, rows)
    check(odd, rows)


def test_reruns_agree(docs):
    a, b = (Counter(tuple(r) for r in mixing.op10(x).collect()) for x in (docs, docs.repartition(3)))
    assert a == b


def test_hot_cell_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    rows = [(i, "a b c", "en", "s1" if i % 3 else "s2", 5) for i in range(300)] + [(1000 + i, "word " * (i + 1), "en", "s3", 5) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)


def test_rates_solve_the_dual(spark):
    """Uncapped sources: copies near exp(dual * size / mean), with the dual that meets the target."""
    rows = [(i, "w " * (1 + i % 17), "en", "abc"[i % 3], 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = defaultdict(list)
    for r in mixing.mix(df).collect():
        by[r.source_size, r.target].append(r)
    for (source_size, target), got in by.items():
        if target >= 2 * source_size:
            continue
        low, high, mean = -60.0, 60.0, source_size / len(got)
        for _ in range(200):
            dual = (low + high) / 2
            words = sum(r.size * min(2, math.exp(min(50, dual * r.size / mean))) for r in got)
            low, high = (dual, high) if words < target else (low, dual)
        cells = defaultdict(list)
        for r in got:
            cells[r.size].append(r.copies)
        for size, copies in cells.items():
            assert abs(sum(copies) - len(copies) * min(2, math.exp(dual * size / mean))) <= 20


def test_edges(spark, none):
    assert mixing.mix(none).count() == 0
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], schema)
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(empty).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    one = spark.createDataFrame([(1, "a b", None, None, None), (None, "c d", None, None, None)], schema)
    assert sum(r.taken for r in mixing.mix(one).collect()) == 6
    kept = mixing.mixed_documents(spark.createDataFrame([(1, "a b", None, "s", None)] * 3, schema))
    assert kept.agg({"taken": "sum"}).first()[0] in (8, 10) and kept.count() == 1


def test_too_few_steps_are_an_error(spark):
    cells = spark.createDataFrame([("=a", 5, 3), ("=a", 9, 2)], "skey string, size long, n_cell long")
    targets = spark.createDataFrame([("=a", 33, 5, 20.0)], "skey string, source_size long, n_docs long, target double")
    with pytest.raises(RuntimeError, match="still missed"):
        mixing.balance(cells, targets, 2, most=1)
    assert mixing.balance(cells, targets, 2).first().dual is not None


def test_small_steps_broadcast_and_exchange_nothing(spark, monkeypatch):
    """Newton steps of few cells are one task each, and find the duals that steps of many tasks find."""
    cells = spark.createDataFrame([(f"={s}", n, 3 + n % 5) for s in "abc" for n in range(1, 40)], "skey string, size long, n_cell long")
    cells = mixing.stored(cells.repartition(4))
    sums = {r.skey: r for r in cells.selectExpr("skey", "size * n_cell as words", "n_cell").groupBy("skey").sum().collect()}
    targets = spark.createDataFrame([(k, r[1], r[2], share * r[1]) for (k, r), share in zip(sums.items(), (0.4, 0.9, 1.6), strict=True)], "skey string, source_size long, n_docs long, target double")
    plans, stored = [], mixing.stored

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows)

    monkeypatch.setattr(mixing, "stored", seen)
    one = {r.skey: r.dual for r in mixing.balance(cells, targets, 2).collect()}
    assert len(plans) > 3 and not any("Exchange" in p for p in plans)
    monkeypatch.setattr(mixing, "TASK_CELLS", 0)
    for most in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        assert {r.skey: pytest.approx(r.dual, abs=1e-6) for r in mixing.balance(cells, targets, 2).collect()} == one
