from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import line_runs
from tests.llm.conftest import DOCS, corpus


def brute(rows, min_lines=4, long_line=50):
    keyed = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, long_seen, result = set(), set(), {}
    ties = Counter(r[0] for r in keyed)
    assert all(n == 1 for k, n in ties.items() if k is not None)
    for doc, text in keyed:
        lines, gone = text.split("\n"), set()
        for i, line in enumerate(lines):
            if len(line) >= long_line and line in long_seen:
                gone.add(i)
            long_seen.add(line)
        for i in range(len(lines) - min_lines + 1):
            run = tuple(lines[i : i + min_lines])
            if run in seen:
                gone |= set(range(i, i + min_lines))
            seen.add(run)
        result[doc, text] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return Counter((r[0], *result[r[0], r[1]]) if r[1] is not None else (r[0], 0, 0, None) for r in rows)


def fixture():
    rows, _ = corpus()
    rows = [r for i, r in enumerate(rows) if r[0] is not None]
    block = "\n".join(f"line {i}" for i in range(9))
    more = [
        (2000, block), (2001, "x\n" + block + "\ny"), (2002, block + "\n" + block), (2003, "a\n" * 70), (2004, "long enough to count as a line by itself, surely"),
        (2005, "é" * 50), (2006, "é" * 50 + "\n" + "é" * 49), (2007, "é" * 49), (2008, "\n\n\n\n\n"), (2009, "line 3\nline 4\nline 5"), (2010, "\n".join(f"n{i % 7}" for i in range(120))),
    ]
    return rows + [(i, t, "en", "s", len(t)) for i, t in more] + [(None, block, None, None, None)]


def test_against_brute_force(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(tuple(r) for r in line_runs.op5(df).collect()) == brute(rows)
    for n, long_line in ((1, 10_000), (7, 20)):
        got = line_runs.dedup_lines(df, min_lines=n, long_line=long_line).select("doc_id", "line_report.*", "text")
        assert Counter(tuple(r) for r in got.collect()) == brute(rows, n, long_line)


def test_runs_are_maximal_copies(spark):
    """Together the runs are what is deleted; each equals its source line by line."""
    rows = fixture()
    df = spark.createDataFrame(rows, DOCS)
    gone = {bytes(r.key): set(r.gone) for r in line_runs.repeated_lines(df, long_line=10_000).collect()}
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    lines = [x for _, _, t in order for x in t.split("\n")]
    ends = [n for _, _, t in order for n in [len(t.split("\n"))]]
    last = {}
    at = 0
    for n in ends:
        last |= dict.fromkeys(range(at, at + n), at + n)
        at += n
    first = {bytes(r.key): r.first for r in line_runs.numbered_documents(df, "doc_id", "text", 50).collect()}
    spans = {}
    for r in line_runs.repeated_runs(df).collect():
        a, n = first[bytes(r.key)] + r.start, r.end - r.start
        assert n >= 4 and r.source < a and lines[a : a + n] == lines[r.source : r.source + n]
        spans.setdefault(bytes(r.key), []).append((r.start, r.end))
    assert {k: {i for a, b in v for i in range(a, b)} for k, v in spans.items()} == gone
    assert max(b - a for v in spans.values() for a, b in v) > 64


def test_ranks_sort_as_the_suffixes_do(spark):
    """The classes of four lines are ranked as their lines are, when lines are ranked by their ids."""
    import hashlib

    texts = ["a\nb\nc\nd\ne", "b\nc\nd\ne\nf", "a\nb\nc\nd\nx", "b\nc\nd\ne\nf", "a\nb\nc\nd"]
    docs_ = line_runs.numbered_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 50)
    lines = docs_.select("first", "n", F.posexplode("told").alias("i", "t")).selectExpr(
        "first", "first + i as at", "first + n as end", "0L as name", "cast(null as long) copied", "cast(null as long) source", "t.id as id"
    )
    one = {r.at: r.name for r in line_runs.deeper(lines, "id", 1).collect()}
    every = [x for t in texts for x in t.split("\n")]
    by_line = {}
    for at, name in one.items():
        assert by_line.setdefault(every[at], name) == name
    ids = sorted(by_line, key=lambda x: hashlib.sha256(x.encode()).digest()[:16])
    assert [by_line[x] for x in ids] == sorted(by_line.values())
    counts = Counter(x for x in every if x in by_line)
    assert [by_line[x] for x in ids] == [sum(counts[y] for y in ids[:i]) for i in range(len(ids))]


def test_edges(odd, none, spark):
    assert line_runs.op5(none).count() == 0
    kept = line_runs.dedup_lines(odd, into="new_report")
    assert set(odd.columns) <= set(kept.columns) and kept.count() == odd.count()
    same = spark.createDataFrame([(1, "b " * 40), (1, "b " * 40), (2, "b " * 40)], "doc_id long, text string")
    assert Counter(tuple(r) for r in line_runs.op5(same).collect()) == Counter({(1, 1, 0, "b " * 40): 2, (2, 1, 1, ""): 1})


def test_hot_lines_go_either_way(spark, monkeypatch):
    """Common lines and copies by broadcast or by shuffle: the same."""
    from quillspark.llm import common

    rows = fixture() + [(3000 + i, "hot line\n" * 3 + f"own {i}", "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    for least in (20, 10**9):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        assert Counter(tuple(r) for r in line_runs.op5(df).collect()) == want


def test_hot_lines_in_rounds_of_many_tasks(spark, monkeypatch):
    from quillspark.llm import common

    rows = fixture() + [(3000 + i, "hot line\n" * 3 + f"own {i}", "en", "s", 1) for i in range(60)]
    monkeypatch.setattr(line_runs, "TASK_SUFFIXES", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert Counter(tuple(r) for r in line_runs.op5(spark.createDataFrame(rows, DOCS)).collect()) == brute(rows)


def test_small_rounds_broadcast_and_exchange_nothing(spark, monkeypatch):
    """Rounds of few suffixes are one task each, and what they find is what rounds of many tasks find."""
    df = spark.createDataFrame(fixture(), DOCS).repartition(4)
    plans, stored = [], line_runs.stored

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stored(rows)

    documents = stored(line_runs.numbered_documents(df, "doc_id", "text", 50))
    monkeypatch.setattr(line_runs, "stored", seen)
    got = [Counter(tuple(r) for r in x.collect()) for x in line_runs.line_copies(documents, 4)]
    assert len(plans) >= 9 and not any("Exchange" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(line_runs, "TASK_SUFFIXES", 300)
    assert [Counter(tuple(r) for r in x.collect()) for x in line_runs.line_copies(documents, 4)] == got
    assert any("Exchange" in p for p in plans) and any("Exchange" not in p for p in plans)


def test_a_taken_name(spark):
    row = line_runs.dedup_lines(spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, line_report int")).first()
    assert row.line_report == 7 and row.line_report_.n_lines == 1


def test_no_python_runs(docs):
    plan = line_runs.op5(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_stage_keeps_the_columns(spark):
    import corpus_pipeline

    rows = fixture()
    out = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.where(F.coalesce(F.length("text"), F.lit(-1)) != F.coalesce("n_chars", F.lit(-1))).count() == 0
