"""The stored index and the search language, against SQLite's full-text search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.operators import matching, postings, search

VOCAB = ["a", "b", "c", "ab", "abc", "Über", "the", "steel", "x1"]


def made_up(n=120, seed=7):
    rng = random.Random(seed)
    return [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 25))) for _ in range(n)] + ["", "a_b", None]


def queries(n=160, seed=8):
    rng = random.Random(seed)

    def phrase():
        s = rng.choice([*VOCAB, "zz", "a_b", '"a b"', '"the"', '""', "uber"]) + ("*" if rng.random() < 0.15 else "")
        return s + (" + " + rng.choice(VOCAB) + ("*" if rng.random() < 0.3 else "") if rng.random() < 0.15 else "")

    def side():
        if rng.random() < 0.2:
            s = "NEAR(" + " ".join(phrase() for _ in range(rng.randint(1, 3))) + (f", {rng.randint(0, 6)}" if rng.random() < 0.6 else "") + ")"
        else:
            s = ("^" if rng.random() < 0.15 else "") + phrase()
        return (rng.choice(["text:", "-text:", "chunk_id :", "{text chunk_id}:", "- {document_id} :", "nope:"]) if rng.random() < 0.05 else "") + s

    def whole(depth=0):
        r = rng.random()
        if depth > 3 or r < 0.4:
            return " ".join(side() for _ in range(rng.randint(1, 2)))
        if r < 0.85:
            return f"{whole(depth + 1)} {rng.choice(['AND', 'OR', 'NOT'])} {whole(depth + 1)}"
        return ("text:" if rng.random() < 0.1 else "") + "(" + whole(depth + 1) + ")"

    found = [whole() for _ in range(n)]
    for q in found[: n // 2]:
        i = rng.randrange(len(q) + 1)
        found.append(q[:i] + rng.choice(['"', "(", ")", ",", "*", "-", " AND ", " OR ", ":", ".", "", "^", "+", "{"]) + q[i + rng.randint(0, 2) :])
    fixed = """a AND ""|a ""|"" a|""|"" AND a|NEAR(a "")|(a) b|a (b)|a NEAR|NEAR|near(a b)|NEAR(a b, x)|NOT a|a AND|AND|foo: a|text : a|- text : a|a -b|1a|a.b|a,b|(a|a)|"a|\"\"\"\"
        NEAR(a b,)|NEAR(,1)|a:b:c|()|TEXT:a|^"" a|a + ""|a * b|text:(a OR b) NOT c|a OR b NOT c OR d|a NOT b c|é|über""".split("|")
    return list(dict.fromkeys(found + [f.strip(" ") for f in fixed]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(made_up())), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return postings.build(docs, str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def wanted():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(chunk_id unindexed, document_id unindexed, text)")
    db.executemany("insert into t values (?, 0, ?)", enumerate(made_up()))
    found = {}
    for q in queries():
        if q.strip():
            try:
                found[q] = dict(db.execute("select chunk_id, bm25(t) from t where t match ?", (q,)).fetchall())
            except sqlite3.OperationalError:
                found[q] = None
    return found


def test_malformed(spark, wanted):
    table = spark.createDataFrame([(q,) for q in wanted], "query string").select(F.col("query").alias("query_id"), "query")
    assert {r.query_id for r in matching.malformed(table).collect()} == {q for q, rows in wanted.items() if rows is None}
    for blank in ("", "  ", None):
        assert matching.parse(blank)["error"] is None


@pytest.mark.parametrize("kind", ["stored", "unstored"])
def test_rows_and_scores(spark, docs, stored, wanted, kind):
    index = stored if kind == "stored" else postings.Unstored(postings.tokenised(docs, "doc_id", "text"), "key")
    table = spark.createDataFrame([(q,) for q in wanted], "query string").select(F.col("query").alias("query_id"), "query")
    got = {}
    for r in matching.search(index, table, 1000).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.bm25
    for q, rows in wanted.items():
        assert set(got.get(q, {})) == set(rows or {}), q
        # where a group or an empty phrase fails beside an OR or NOT, the other counts some of what it looked at
        if rows and not (("NEAR" in q or '""' in q) and (" OR " in q or " NOT " in q)):
            assert all(abs(got[q][k] - v) < 1e-9 for k, v in rows.items()), q
    assert sum(bool(x) for x in wanted.values()) > 60


def test_ranks_and_filter(spark, stored):
    table = spark.createDataFrame([(1, "a OR b")], "query_id int, query string")
    every = matching.search(stored, table, 1000).orderBy("rank").collect()
    order = sorted(every, key=lambda r: (round(r.bm25, 9), r.doc_id))
    assert [r.rank for r in every] == list(range(1, len(every) + 1)) and [r.doc_id for r in every] == [r.doc_id for r in order]
    some = matching.search(stored, table, 3, within=spark.createDataFrame([(every[4].doc_id,), (every[1].doc_id,)], "doc_id long")).orderBy("rank").collect()
    assert [(r.rank, r.doc_id, r.bm25) for r in some] == [(1, every[1].doc_id, every[1].bm25), (2, every[4].doc_id, every[4].bm25)]
    assert matching.search(stored, table, 3, within=spark.createDataFrame([], "doc_id long")).count() == 0
    assert matching.search(stored, table.limit(0), 3).count() == 0


def test_near_sweep():
    assert matching.close_places([[1], [2, 3]], [1, 1], 10) == [[1], [2, 3]]
    assert matching.close_places([[0, 50], [20]], [1, 1], 5) == [[], []]
    assert matching.close_places([[0], [6]], [1, 1], 5) == [[0], [6]] and matching.close_places([[0], [7]], [1, 1], 5) == [[], []]


def phrases(spark, *words):
    return spark.createDataFrame([(" ".join(w), i, [x]) for w in words for i, x in enumerate(w)], "query_id string, phrase_no int, words array<string>")


def same_as_new(spark, index, rows, tmp):
    """The index finds what one that is built of rows anew finds."""
    asked = phrases(spark, ["a"], ["a", "b"], ["steel", "the"], ["new"], ["zz"])
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    again = postings.build(docs, str(tmp))
    find = lambda x: sorted((r.query_id, r.rank, r.doc_id, round(r.bm25, 9)) for r in search.bm25(x, asked, 1000).collect())
    assert find(index) == find(again) == find(search.tokenised(docs)) and find(index)
    assert index.stats().first() == again.stats().first()
    pairs = lambda x: sorted(map(tuple, x.document_frequencies().collect()))
    assert pairs(index) == pairs(again)


def test_documents_are_replaced_and_removed(spark, docs, tmp_path):
    rows = dict(enumerate(made_up()))
    index = postings.build(docs, str(tmp_path / "one"))
    some = {3: "new words a b", 4: "", 5: None, 900: "a new one"}
    index.replace(spark.createDataFrame(sorted(some.items()), "doc_id int, text string"))
    rows |= some
    same_as_new(spark, index, rows, tmp_path / "two")
    index.remove(spark.createDataFrame([(3,), (7,), (7,), (12345,)], "id int"))
    rows = {k: v for k, v in rows.items() if k not in (3, 7)}
    same_as_new(spark, index, rows, tmp_path / "three")
    index.replace(spark.createDataFrame([(7, "a b back again new")], "doc_id long, text string"))
    rows[7] = "a b back again new"
    same_as_new(spark, index, rows, tmp_path / "four")
    assert index.versions() == [0, 1, 2, 3]
    small = index.compact(str(tmp_path / "five"))
    assert small.versions() == [0]
    same_as_new(spark, small, rows, tmp_path / "six")


def test_a_version_that_was_not_finished_does_not_count(spark, docs, tmp_path):
    index = postings.build(docs, str(tmp_path / "one"))
    rows = dict(enumerate(made_up()))
    lost = spark.createDataFrame([(1, ["lost"], 1)], "key long, toks array<string>, dl int")
    index._write(1, lost, None, index.layout()[0])  # and no commit
    same_as_new(spark, index, rows, tmp_path / "two")
    index.replace(spark.createDataFrame([(2, "new")], "doc_id long, text string"))
    same_as_new(spark, index, rows | {2: "new"}, tmp_path / "three")


def test_only_partitions_of_the_words_are_read(spark, stored):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(stored.rows_of(spark.createDataFrame([("steel",)], "word string")))
    assert "PartitionFilters: [version" in text and "bucket" in text.split("PartitionFilters")[1].split("]")[0] and "word#" in text and "In(word, [steel])" in text or "EqualTo(word,steel)" in text
    files = stored.rows_of(spark.createDataFrame([("steel",)], "word string")).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in files}) == 1


def test_many_words_and_prefixes(spark, stored, monkeypatch):
    asked = phrases(spark, ["a"], ["steel", "the"])
    few = sorted(map(tuple, search.bm25(stored, asked, 50).collect()))
    table = spark.createDataFrame([(1, "ab* NOT abc*")], "query_id int, query string")
    some = sorted(map(tuple, matching.search(stored, table, 50).collect()))
    for name in ("FEW_WORDS", "BROADCAST_WORDS", "BROADCAST_KEYS"):
        monkeypatch.setattr(postings, name, 0)
    assert sorted(map(tuple, search.bm25(stored, asked, 50).collect())) == few
    assert sorted(map(tuple, matching.search(stored, table, 50).collect())) == some


def test_no_documents(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert search.bm25(index, phrases(spark, ["a"]), 5).count() == 0 and tuple(index.stats().first()) == (0, None)
    index.replace(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert [r.doc_id for r in search.bm25(index, phrases(spark, ["a"]), 5).collect()] == [1]


def test_long_and_repetitive_text(spark, tmp_path):
    docs = spark.createDataFrame([("long", "the a " * 100_000 + "end"), ("short", "the end")], "doc_id string, text string")
    index = postings.build(docs, str(tmp_path / "long"))
    table = spark.createDataFrame([(1, '"a end"'), (2, "NEAR(the end, 0)"), (3, "the")], "query_id int, query string")
    got = {(r.query_id, r.doc_id) for r in matching.search(index, table, 5).collect()}
    assert got == {(1, "long"), (2, "short"), (3, "long"), (3, "short")}


def test_terms(spark, stored):
    """A malformed term is reported and the others are searched."""
    terms = spark.createDataFrame([("q", 0, "a AND ("), ("q", 1, "steel NOT the"), ("q", 2, "IS 302-1"), ("r", 0, '"')], "query_id string, term_pos int, term string")
    found = search.best_term(stored, terms, 20).collect()
    assert {(r.query_id, r.term) for r in found} == {("q", "steel NOT the")}
    quoted = search.best_term(stored, terms.where("term_pos = 1"), 20, quote=True)
    assert quoted.count() == 0 and search.best_term(stored, spark.createDataFrame([("q", 0, 'a b "')], terms.schema), 20, quote=True).count() > 0


def test_index_rows_are_blocks_of_documents(spark, tmp_path, monkeypatch):
    """What is moved and sorted is a row a block and word, not one a document and word; what is found stays the same."""
    texts = ["a b a", "b c", None, "", "c " * 30 + "a"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(2_000)], "doc_id long, text string").coalesce(2)
    index = postings.build(docs, str(tmp_path / "whole"))
    assert spark.read.parquet(index.path + "/rows").where("bucket >= 0").count() <= 3 * 2
    monkeypatch.setattr(postings, "BLOCK_WORDS", 20)
    small = postings.build(docs.where("doc_id < 40"), str(tmp_path / "small"))
    for built, n in ((index, 2_000), (small, 40)):
        want = {(i, w): [k for k, x in enumerate(t.split()) if x == w] for i in range(n) for t in [texts[i % 5] or ""] for w in t.split()}
        rows = built.rows_of(spark.createDataFrame([("a",), ("b",), ("c",)], "word string")).collect()
        assert len(rows) == len(want) and {(r.key, r.word): r.places for r in rows} == want
        assert all(r.dl == len(texts[r.key % 5].split()) for r in rows)
        assert {r.word: r.df for r in built.document_frequencies().collect()} == {w: sum(k[1] == w for k in want) for w in "abc"}


def test_equal_phrases_meet_documents_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red steel pipe"), (2, "steel valve"), (3, "red pipe of steel")], "doc_id long, text string")
    table = spark.createDataFrame([(i, "NEAR(red steel, 4)" if i % 2 else "steel OR red") for i in range(20)], "query_id long, query string")
    asked, held = [], matching.held
    monkeypatch.setattr(matching, "held", lambda index, phrases: asked.append(phrases.count()) or held(index, phrases))
    index = postings.Unstored(postings.tokenised(docs, "doc_id", "text"), "key")
    got = {(r.query_id, r.doc_id) for r in matching.search(index, table, 5).collect()}
    assert asked == [2]
    assert got == {(i, d) for i in range(20) for d in (1, 2, 3) if i % 2 == 0 or d != 2}


def test_prefixes_move_no_rows_of_the_index(spark, stored, monkeypatch):
    """The words that a prefix stands for are found where they lie, however many; what documents hold of all terms is found once, and kept."""
    table = spark.createDataFrame([(1, "ab* OR steel"), (2, '"a b" OR ^the')], "query_id int, query string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, matching.search(stored, table, 50).collect()))
    plans, held = [], matching.held
    monkeypatch.setattr(matching, "held", lambda *own: plans.append(plan(found := held(*own))) or found)
    monkeypatch.setattr(postings, "FEW_WORDS", 4)
    monkeypatch.setattr(postings, "BROADCAST_WORDS", 4)  # of the queries' own words no more, of those and the words with the prefix six
    got = matching.search(stored, table, 50)
    assert "SortMergeJoin" not in plans[0] and plans[0].count("hashpartitioning(") == plans[0].count("hashpartitioning(key#") == 2
    assert f"{stored.path}/rows" not in plan(got) and "/table-" in plan(got)
    assert sorted(map(tuple, got.collect())) == want and want


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_the_build_moves_no_rows_of_words(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a w{i} é{i % 7} a") for i in range(500)], "doc_id long, text string").coalesce(2)
    before = shuffled(spark)
    index = postings.build(docs, str(tmp_path / "whole"))
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 100
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    monkeypatch.setattr(postings, "OPEN_FILES", 3)  # of 16 partitions and that of all documents
    few = postings.build(docs, str(tmp_path / "few"))
    for x in (index, few):
        assert {r.word: r.df for r in x.document_frequencies().collect()} == {f"w{i}": 1 for i in range(500)} | {f"e{i}": len(range(i, 500, 7)) for i in range(7)} | {"a": 500}
        assert tuple(x.stats().first()) == (500, 4.0) and x.documents().count() == 500
        rows = x.rows_starting(spark.createDataFrame([("w49",), ("a",), ("zz",)], "prefix string")).collect()
        assert sorted((r.key, r.prefix, r.dl, r.f, r.places) for r in rows) == sorted([(i, "a", 4, 2, [0, 3]) for i in range(500)] + [(i, "w49", 4, 1, [1]) for i in (49, *range(490, 500))])


def test_documents_without_words(spark, tmp_path):
    index = postings.build(spark.createDataFrame([(1, None), (2, ""), (3, "- -")], "doc_id long, text string"), str(tmp_path / "none"))
    assert tuple(index.stats().first()) == (3, 0.0) and sorted(tuple(r) for r in index.documents().collect()) == [(1, 0), (2, 0), (3, 0)]
    assert matching.search(index, spark.createDataFrame([(1, "a* OR b")], "query_id int, query string"), 5).count() == 0
