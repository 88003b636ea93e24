"""Operators on hand-written rows, against plain Python."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T
from quillspark.functions import vectors as X
from quillspark.operators import catalogue, chunking, hybrid, ingest, rules, safety, search
from quillspark.sources import documents

PAGE = "Foreword text\n1 SCOPE\nThis covers IS 302-1 heaters.\n\nMore.\n2 REFERENCES\nIS 456 and IS/ISO 2859-1 and IS 456 too\n3.1 Marking and test\nEach unit shall be marked. See IS 99999."


def value(spark, column, **given):
    schema = ",".join(f"{k} string" for k in given) or "x int"
    return spark.createDataFrame([tuple(given.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("d1", 1, PAGE), ("d1", 2, "  \n "), ("d1", 3, "4 TESTS\n" + "\n\n".join("para %d " % i + "x" * 150 for i in range(9))),
        ("d2", 1, "no heading here\n\nsecond"), ("d3", 1, None)
    ]
    return spark.createDataFrame(rows, "document_id string, page_number int, text string")


def test_scalars(spark):
    t = F.col("t")
    cases = [
        (T.standard_number(t), "see IS 302-1 and IS 456", "IS 302-1"), (T.standard_number(t), "is 302", None), (T.standard_number(t), "IS 302 : 2023", "IS 302"), (T.standard_number(t), "IS456", "IS456"),
        (T.edition(t), "( second Revision )", "second Revision"), (T.publication_year(t), "IS 2062 : 2011", "2011"), (T.publication_year(t), "IS 2011 only", None),
        (T.title(t), "x\nIndian Standard\nWATER HEATERS\n— SPECIFICATION\n( First Revision )\nmore", "WATER HEATERS — SPECIFICATION"), (T.title(t), "none", None),
        (T.category(t), "An electric GEYSER", "water_heater"), (T.category(t), "water_purifier", "water_purifier"), (T.category(t), "chair", None), (T.category(t), "", None),
        (T.intended_use(t), "home or industrial", "domestic"), (T.heater_type(t), "tankless", "instant"),
        (T.short_title(t), " " + "a" * 59 + " bcd ", "a" * 59 + "…"), (T.short_title(t), " short ", "short"),
        (F.array_join(T.content_words(t), ","), "Which standard covers batteries and bars of boxes?", "battery,bar,box"),
        (F.array_join(T.query_classes(t), ","), "Is testing documentation mandatory?", "MANDATORY_STATUS,TESTING,DOCUMENTATION"), (F.array_join(T.query_classes(t), ","), "chairs", "GENERAL_PRODUCT_STANDARD"),
        (F.array_join(T.prioritised_types(T.query_classes(t)), ","), "how to apply", "BIS_SCHEME,CERTIFICATION_GUIDANCE"),
        (F.array_join(T.requirement_categories(t), ","), "The latest drawing", "TESTING,DOCUMENTATION"), (T.states_obligation(t), "requirements", False), (T.states_obligation(t), "It MUST", True),
        (T.label(t), "CONFORMITY_ASSESSMENT", "Conformity Assessment"), (F.array_join(T.tokens(t), "|"), "Čaj-über_x 1²", "caj|uber|x|1²"),
    ]
    for column, text, want in cases:
        assert value(spark, column, t=text) == want, (text, want)


def test_folding(spark):
    import unicodedata

    letters = [chr(c) for c in (*range(0x20, 0x250), 0x212A, 0x212B, 0x1E9E, 0xFB01, 0x416, 0x939)]
    rows = spark.createDataFrame([(c + "x " + c,) for c in letters], "t string").select(
        "t", T.folded(F.col("t")).alias("f"), F.size(T.tokens(F.col("t"))).alias("n"), T.n_tokens(F.col("t")).alias("m")
    ).collect()
    base = lambda c: unicodedata.normalize("NFD", c)[0] if 0xC0 <= ord(c) < 0x250 else c
    want = lambda t: "".join(base(x) for x in "".join(base(c) for c in t).lower())
    assert all(r.f == want(r.t) and r.n == r.m for r in rows)


def test_hash_embedding(spark):
    text = "é😀ab"
    seed = sum(map(ord, text))
    assert value(spark, T.hash_embedding(F.col("t")), t=text) == [((seed + i) % 100) / 100 for i in range(8)]


def test_search_terms(spark):
    profile = {f: F.col(f) for f in V.PROFILE_FIELDS}
    given = dict.fromkeys(V.PROFILE_FIELDS) | {
        "product_name": " Geyser ", "product_category": "water_heater", "product_type": "storage", "capacity": "25 L", "technology": ""
    }
    assert value(spark, T.search_terms(profile), **given) == ["Geyser", "water_heater", "storage", "storage water_heater", "25 L"]


def split_page(text):
    heading = re.compile(r"^(\d+(?:\.\d+)*)\s+([A-Z][A-Za-z0-9 ,\-/&()]{2,80})$", re.M)
    found = list(heading.finditer(text))
    parts = [(None, text[: found[0].start()])] if found else [(None, text)]
    parts += [(m[1], text[m.start() : n.start() if n else len(text)]) for m, n in zip(found, [*found[1:], None], strict=False)]
    return [(k, v.strip()) for k, v in parts if v.strip()]


def chunk_page(text):
    out = []
    for section, body in split_page(text or ""):
        now = ""
        for p in (x.strip() for x in body.split("\n\n") if x.strip()):
            joined = f"{now}\n\n{p}" if now else p
            if len(joined) <= 800 or not now:
                now = joined
            else:
                out.append((section, now))
                now = f"{now[-100:]}\n\n{p}"
        if now:
            out.append((section, now))
    return out


def test_chunks(spark, pages):
    got = [(r.document_id, r.chunk_index, r.page_number, r.section, r.text) for r in chunking.chunks(pages).orderBy("document_id", "chunk_index").collect()]
    want = []
    for doc in ("d1", "d2"):
        rows = [(r.page_number, s, t) for r in pages.where(F.col("document_id") == doc).orderBy("page_number").collect() for s, t in chunk_page(r.text)]
        want += [(doc, i, *r) for i, r in enumerate(rows)]
    assert got == want and len(want) > 6


def test_clauses_drop_the_preamble(pages):
    rows = chunking.clauses(pages).orderBy("document_id", "page_number", "section_pos").collect()
    assert [r.section for r in rows] == ["1", "2", "3.1", "4", None]


def test_features_scope_requirements(spark, pages):
    got = {(r.feature_type, r.value, r.section) for r in chunking.features(pages).where("page_number = 1").collect()}
    assert got == {("standard_number_mention", x, None) for x in ("IS 302-1", "IS 456", "IS/ISO 2859-1", "IS 99999")} | {
        ("section_heading", f"{a} {b}", a) for a, b in (("1", "SCOPE"), ("2", "REFERENCES"), ("3.1", "Marking and test"))
    }
    scope = chunking.scopes(pages).collect()
    assert [(r.document_id, r.page_number, r.scope_text) for r in scope] == [("d1", 1, "1 SCOPE\nThis covers IS 302-1 heaters.\n\nMore.")]
    own = spark.createDataFrame([("d1", "IS 99999")], "document_id string, standard_number string")
    need = chunking.requirements(pages, own).collect()
    assert [(r.category, r.clause_number, r.referenced_standards) for r in need] == [("TESTING", "3.1", None), ("MARKING", "3.1", None)]
    assert chunking.requirements(pages).first().referenced_standards == "IS 99999"
    meta = {r.document_id: r for r in chunking.metadata(pages).collect()}
    assert meta["d1"].standard_number == "IS 302-1" and meta["d3"].standard_number is None


def test_vectors(spark):
    rows = [
        (1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "a"), (3, [0.1, 0.9, 0.0], "b"), (4, [0.0, 0.0, 0.0], "b"),
        (5, [0.7, 0.3, 0.0], "c"), (6, None, "c")
    ]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>, document_id string")
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, query_vector array<float>")
    top = lambda **o: [r.vec_id for r in search.vector_top_k(asked, table, 3, **o).orderBy("rank").collect()]
    assert top() == [1, 5, 3]
    assert top(parents=spark.createDataFrame([("b",)], "document_id string")) == [3]
    assert top(within=table.select("vec_id").limit(0)) == []
    assert top(within=table.where("vec_id in (2, 3)").select("vec_id")) == [3, 2]
    text = spark.createDataFrame([("[1.0,2.5]",), (None,)], "t string").select(X.from_text(F.col("t")).alias("v"))
    assert [r.v for r in text.collect()] == [[1.0, 2.5], None]
    with pytest.raises(Exception, match="not a vector"):
        spark.createDataFrame([("[1,",)], "t string").select(X.from_text(F.col("t"))).collect()


def fts(texts, query, k=20):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, body)")
    db.executemany("insert into t values (?, ?)", enumerate(texts))
    rows = db.execute("select id, bm25(t) from t where t match ?", (query,)).fetchall()
    return sorted(rows, key=lambda r: (round(r[1], 9), r[0]))[:k]


def test_bm25_against_sqlite(spark):
    import random

    rng = random.Random(4)
    vocab = ["water", "heater", "heaters", "storage", "über", "tank", "a", "of", "the", "steel"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["", "water_heater", "Über-Tank"]
    corpus = search.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    terms = ["water", "water heater", "water_heater", "uber tank", "steel", "absent", "IS 302-1", "a AND b", ""]
    table = spark.createDataFrame([(t, 0, t) for t in terms], "query_id string, term_pos int, term string")
    got = search.bm25(corpus, search.term_phrases(table), 20).orderBy("query_id", "rank").collect()
    for term in terms[:6]:
        want = fts(texts, term)
        own = [(r.doc_id, r.bm25) for r in got if r.query_id == term]
        assert [x for x, _ in own] == [x for x, _ in want] and all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(own, want))
    assert not [r for r in got if r.query_id in terms[6:]]
    quoted = search.bm25(corpus, search.term_phrases(table, quote=True), 5)
    assert {r.query_id for r in quoted.collect()} >= {"water heater", "water_heater"}


def test_hybrid(spark):
    sem = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5), ("q", 3, 0.7)], "query_id string, chunk_id int, score double")
    key = spark.createDataFrame([("q", 2, -3.0, "t1"), ("q", 4, -1.0, "t2"), ("q", 9, -9.0, "t")], "query_id string, chunk_id int, bm25 double, term string")
    chunks = spark.createDataFrame(
        [(1, "A", "alpha"), (2, "B", "beta IS 456"), (3, "A", "gamma"), (4, "C", "Storage")],
        "chunk_id int, document_id string, text string"
    )
    docs = spark.createDataFrame(
        [("A", "a.pdf", "OTHER"), ("B", "b.pdf", "QCO"), ("C", "c.pdf", "OTHER")],
        "document_id string, document_name string, document_type string"
    )
    asked = spark.createDataFrame(
        [("q", ["is 456"], ["storage", None, ""], ["QCO"])],
        "query_id string, identifiers array<string>, attributes array<string>, priority_types array<string>"
    )
    got = {r.document_id: r for r in hybrid.rerank(hybrid.merge(sem, key, chunks, docs), asked, 2).collect()}
    assert set(got) == {"A", "B"} and abs(got["B"].final_score - (0.35 + 0.10 + 0.20)) < 1e-12 and abs(got["A"].final_score - 0.45) < 1e-12
    assert [e.chunk_id for e in got["A"].evidence] == [1, 3] and got["B"].matched_terms == ["t1"] and got["B"].rank == 1
    assert got["A"].keyword_score is None and got["B"].semantic_score == 0.5
    profiles = spark.createDataFrame([("q", "gamma", None)], "query_id string, product_category string, product_type string")
    status = {r.document_id: r.applicability_status for r in rules.assess(hybrid.rerank(hybrid.merge(sem, key, chunks, docs), asked, 2), profiles).collect()}
    assert status == {"A": "POTENTIALLY_APPLICABLE", "B": "NEEDS_CLARIFICATION"}


def test_off_corpus(spark):
    asked = spark.createDataFrame(
        [(1, "Which standard applies to laptops"), (2, "concrete cover"), (3, "what is the standard"), (4, "batteries and chairs")],
        "query_id int, text string"
    )
    found = spark.createDataFrame([(1, "Concrete bars"), (2, "concrete mixes"), (3, "x"), (4, "A battery")], "query_id int, text string")
    got = {r.query_id: (r.n_words, r.off_corpus) for r in search.off_corpus(asked, found).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (0, False), 4: (2, False)}


def test_profile_fold(spark):
    turns = [
        ("c", 2, {"product_category": "geyser", "intended_use": "for the home", "capacity": "9 L"}), ("c", 1, {"product_category": "appliance", "capacity": "25 L"}),
        ("c", 3, {"product_category": "RO system", "intended_use": "industrial"}), ("d", 1, {"product_type": "tankless", "product_category": "water heater"}), ("e", 1, {}),
    ]
    got = {
        r.conversation_id: r for r in rules.fold_profiles(
            spark.createDataFrame(turns, "conversation_id string, turn int, updates map<string,string>")
        ).collect()
    }
    assert (got["c"].product_category, got["c"].intended_use, got["c"].capacity) == ("water_heater", "domestic", "25 L")
    assert got["c"].questions == [
        "Earlier you described this as a water heater, but this message suggests a water purifier. Which is correct?",
        "Earlier you said this was for domestic use, but this message suggests commercial use. Which is correct?",
    ]
    assert (got["d"].product_type, got["d"].product_category, got["d"].questions) == ("instant", "water_heater", [])
    assert got["e"].product_name is None


def test_parsed_fields_and_questions(spark):
    raw = "product_name: Geyser X\nbogus: 1\nCapacity:  25 L \nmaterials: Unknown\nfree text\ncapacity: 30 L"
    assert value(spark, rules.parsed_fields(F.col("t")), t=raw) == {"product_name": "Geyser X", "capacity": "30 L"}
    profile = {f: F.col(f) for f in V.PROFILE_FIELDS}
    blank = dict.fromkeys(V.PROFILE_FIELDS)
    ask = lambda **k: [q.field for q in value(spark, rules.missing_questions(profile), **(blank | k))]
    assert ask() == ["product_category"] and ask(product_category="water_purifier", capacity="1") == [
        "technology", "intended_use", "electrical_characteristics"
    ]
    assert ask(product_category="chair") == [f for f, _ in V.FALLBACK_QUESTIONS]
    assert rules.KEEP == value(spark, rules.update_decision(F.lit("capacity"), F.lit("1"), F.lit("2")))


def test_checklist(spark):
    rows = [
        ("q", "d", "doc.pdf", "POTENTIALLY_APPLICABLE", [(1, " It shall be marked and tested. "), (2, "Background on testing.")]),
        ("q", "e", "e.pdf", "NEEDS_CLARIFICATION", [(3, "shall be tested")])
    ]
    got = rules.checklist_items(
        spark.createDataFrame(
            rows,
            "query_id string, document_id string, document_name string, applicability_status string, evidence array<struct<chunk_id:int,text:string>>"
        )
    ).collect()
    assert [(r.chunk_id, r.category, r.title, r.status) for r in got] == [
        (1, "TESTING", "Testing requirement referenced in doc.pdf", "POTENTIALLY_APPLICABLE"),
        (1, "MARKING", "Marking requirement referenced in doc.pdf", "POTENTIALLY_APPLICABLE")
    ]


def test_answer_checks(spark):
    t = F.col("t")
    for text, want in (("It is mandatory.", True), ("It has not been found to be mandatory. Fine.", False), ("No. It is compulsory!", True)):
        assert value(spark, safety.affirms_mandatory(t), t=text) is want
    assert value(spark, safety.lists_requirements(t), t="Do:\n- **Testing** of x") and not value(spark, safety.lists_requirements(t), t="discusses testing")
    profile = {"product_category": F.lit("water_heater"), "capacity": F.lit(None).cast("string")}
    for text, want in (("**Category:** water_purifier", True), ("Category: Water heater", False), ("Capacity: 3 L", False)):
        assert value(spark, safety.restates_wrongly(t, profile), t=text) is want
    answers = spark.createDataFrame(
        [(1, "Use IS 456:2000 and IS 14587:1998, also IS 14587.", 0), (2, "IS 302 is fine", 1)],
        "answer_id int, text string, n_requirements int"
    )
    found = spark.createDataFrame([(1, "IS_456_2000.pdf", "x"), (2, "f", "see IS 302")], "answer_id int, document_name string, text string")
    got = {r.answer_id: r.unverified for r in safety.unverified_numbers(answers, found).collect()}
    assert got == {1: ["IS 14587:1998"], 2: []}
    verdicts = {r.answer_id: r for r in safety.verdict(answers, found).collect()}
    assert verdicts[1].fabricated_numbers == ["IS 14587", "IS 14587:1998", "IS 456:2000"] and verdicts[2].is_safe
    assert value(
        spark, safety.with_warning(t, F.array(F.lit("IS 1"), F.lit("IS 2"))), t="Ok. "
    ).startswith("Ok.\n\n⚠️ Unverified: this answer mentions IS 1, IS 2, which do not")


def test_trim(spark):
    keep = "The documents do not cover chairs. They do cover the following:\n- concrete"
    assert value(spark, safety.trimmed(F.col("t")), t=keep) == keep
    cut = value(spark, safety.trimmed(F.col("t")), t="Not covered. Typically you need BIS marks. More.")
    assert cut == "Not covered.\n\n" + V.TRIM_NOTICE
    assert value(spark, safety.trimmed(F.col("t")), t="Not covered. See ISO 9001.").startswith("Not covered.\n\nI've stopped")
    assert value(spark, safety.trimmed(F.col("t")), t=" ") == " "


def test_intake(spark, tmp_path):
    rows = [
        (b"", "application/pdf", "a"), (b"%PDF-1", "text/plain", "a"), (b"PDF", "application/pdf", "a"),
        (b"%PDF-1", "application/pdf", " "), (b"%PDF-1", "application/pdf", "a"), (b"x" * 20, None, "a")
    ]
    df = spark.createDataFrame(rows, "c binary, m string, n string").select(ingest.reject_reason(F.col("c"), F.col("m"), F.col("n"), 10).alias("r"))
    assert [r.r for r in df.collect()] == ["empty", "wrong type", "not a pdf", "no name", None, "too large"]
    for name, data in (("b.pdf", b"%PDF-x"), ("a.pdf", b"junk"), ("c.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(data)
    got = documents.pdf_folder(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(r.file_name, r.reject_reason) for r in got] == [("a.pdf", "not a pdf"), ("b.pdf", None)]
    assert value(spark, ingest.checked_type(F.col("t")), t="") == "OTHER" and value(spark, ingest.checked_type(F.col("t")), t="X") is None


def test_replace_and_delete(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "document_id string, n int")
    new = spark.createDataFrame([("a", 9), ("c", 5)], "document_id string, n int")
    rows = lambda df: sorted((r.document_id, r.n) for r in df.collect())
    assert rows(ingest.replaced(old, new, "document_id")) == [("a", 9), ("b", 3), ("c", 5)]
    path = str(tmp_path / "t")
    ingest.write_partitions(old, path, "document_id")
    for _ in range(2):
        ingest.write_partitions(new, path, "document_id")
    assert rows(spark.read.parquet(path)) == [("a", 9), ("b", 3), ("c", 5)]
    left = ingest.cascade({"t": old}, spark.createDataFrame([("a",)], "document_id string"), "document_id")
    assert rows(left["t"]) == [("b", 3)]
    seeds = ingest.new_only(new, old, "document_id")
    assert rows(seeds) == [("c", 5)] and rows(ingest.new_only(new, old.unionByName(seeds), "document_id")) == []


def test_history(spark):
    rows = [("c", i, "u" if i % 2 else "a", f"text {i}") for i in range(1, 10)] + [("d", 1, "u", "only")]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in catalogue.last_turns(m, "conv_id", "turn", 6).where("conv_id = 'c'").collect()) == [4, 5, 6, 7, 8, 9]
    assert {r.turn for r in catalogue.sticky(m, "conv_id", "turn", F.col("text") == "text 7").where("mode").collect()} == {7, 8, 9}
    assert {r.conv_id: r.title for r in catalogue.titles(m, "conv_id", "turn", "text").collect()} == {"c": "text 1", "d": "only"}
    own = spark.createDataFrame([(1, None), (2, "u")], "id int, user_id string")
    assert [r.id for r in catalogue.owned_by(own, F.lit(None)).collect()] == [1] and [r.id for r in catalogue.owned_by(own, F.lit("u")).collect()] == [2]


def test_ladder(spark):
    t = spark.createDataFrame([(1, "Big red water heater"), (2, "water heater small"), (3, "red paint"), (4, "the red water")], "id int, name string")
    q = spark.createDataFrame(
        [("a", "red water heater"), ("b", "hot water heater"), ("c", "blue paint"), ("d", "zzz"), ("e", " ")],
        "query_id string, text string"
    )
    got = {}
    for r in catalogue.ladder(t, q, "id", "name").collect():
        got.setdefault(r.query_id, set()).add((r.id, r.rung))
    assert got == {"a": {(1, 0)}, "b": {(1, 2), (2, 2)}, "c": {(3, 3)}}


def test_scanned_pages(spark):
    words = spark.createDataFrame(
        [("d", 1, 2, "b", 80.0), ("d", 1, 1, "a", -1.0), ("d", 1, 3, " ", 60.0), ("d", 2, 1, None, None)],
        "document_id string, page_number int, pos int, word string, confidence double"
    )
    got = {r.page_number: (r.text, r.ocr_confidence) for r in documents.pages_from_words(words).collect()}
    assert got == {1: ("a b", 0.7), 2: ("", None)}
    assert value(spark, T.table_block(F.array(F.array(F.lit("a"), F.lit(None)), F.array(F.lit("b"), F.lit("c"))))) == "[TABLE]\na | \nb | c\n[/TABLE]"


def test_streaming(spark, tmp_path):
    from quillspark.streaming import landing

    rows = [("d1", 1, PAGE, datetime.datetime(2024, 1, 1)), ("d2", 1, "plain", datetime.datetime(2024, 1, 1, 0, 5))]
    schema = "document_id string, page_number int, text string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for n in range(2):
        landing.index_stream(landing.landing(spark, str(tmp_path / "in"), schema), chunking.chunks, out, str(tmp_path / f"c{n}")).awaitTermination()
    assert spark.read.parquet(out).count() == len(chunk_page(PAGE)) + 1
    counts = landing.counted(landing.landing(spark, str(tmp_path / "in"), schema), "ts", "10 minutes", "1 minute")
    counts.writeStream.format("memory").queryName("n").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("n").collect()] == [2]


def test_long_texts_end(spark):
    """Patterns over groups run as loops: long numbers, dotted leaders and terms of many words don't overflow the matcher's stack."""
    long = "1" + ".1" * 100_000
    texts = [long + " Scope of it\nbody", long + "\n1 SCOPE\nx", "1 SCOPE" + "." * 200_000 + " 7", "1.1 " * 50_000, "Indian Standard\nX\n" + long + " Title"]
    pages_ = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    assert {(r.document_id, len(r.section or "")) for r in chunking.sections(pages_).collect()} >= {("0", len(long)), ("1", 1)}
    assert chunking.scopes(pages_).count() == 1 and chunking.features(pages_).count() >= 2
    assert {r.document_id: r.title for r in chunking.metadata(pages_).collect()}["4"] == "X"
    terms = spark.createDataFrame([("q", 0, "ab " * 60_000), ("q", 1, "ab " * 60_000 + "!")], "query_id string, term_pos int, term string")
    assert search.term_phrases(terms).count() == 60_000


@pytest.mark.parametrize("bound", [0, 2_000])
def test_many_phrases_as_few(spark, monkeypatch, bound):
    """Beyond the bound of a broadcast the same rows come by joins."""
    monkeypatch.setattr(search, "BROADCAST_QUERIES", bound)
    monkeypatch.setattr(search, "BROADCAST_WORDS", bound)
    docs = spark.createDataFrame([(1, "red pump, red valve"), (2, "a pump red"), (3, "valve"), (4, None)], "doc_id long, text string")
    phrases = spark.createDataFrame(
        [("a", 0, ["red"]), ("a", 1, ["pump"]), ("b", 0, ["red", "valve"]), ("c", 0, ["none"]), ("d", 0, [])],
        "query_id string, phrase_no int, words array<string>"
    )
    rows = search.bm25(search.tokenised(docs), phrases, 5).collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {("a", 1), ("a", 2), ("b", 1)}
    asked = spark.createDataFrame([("q", "pumps of valve"), ("r", "of the"), ("s", "boats")], "query_id string, text string")
    found = spark.createDataFrame([("q", "Pump"), ("q", "pump pumps"), ("s", "cars")], "query_id string, text string")
    got = {r.query_id: (r.n_words, r.grounding, r.off_corpus) for r in search.off_corpus(asked, found).collect()}
    assert got == {"q": (2, 0.5, False), "r": (0, None, False), "s": (1, 0.0, True)}


def test_ladder_counts_equal_texts_once(spark):
    """Titles and queries of equal texts meet once; what they find equals the pairs of rows."""
    names = ["red bolt", "Red  Bolt", "new red bolt of steel wire", "blue nut", "nut blue", None, " ", "of it"]
    asked = ["new red bolt", "new red bolt of steel wire", "a nut blue", "x of", "of steel wire", None, "zzz"]
    t = spark.createDataFrame([(i, names[i % 8]) for i in range(800)] + [(0, "blue nut"), (0, "red bolt")], "id int, name string")
    q = spark.createDataFrame([(i, asked[i % 7]) for i in range(140)] + [(0, "a nut blue")], "query_id int, text string")
    _, _, met = catalogue._ladder_classes(t, q, "id", "name")
    assert met.count() <= 7 * 8
    pairs = {}
    for r in catalogue.ladder(t, q, "id", "name").collect():
        pairs.setdefault((r.query_id, r.rung), []).append(r.id)
    got = {(r.query_id, r.rung): (r.found, r.first) for r in catalogue.ladder_counts(t, q, "id", "name").collect()}
    assert got == {k: (len(v), min(v)) for k, v in pairs.items()} and all(len(v) == len(set(v)) for v in pairs.values())

    texts, phrases = {}, {}
    for i, name in [(r.id, r.name) for r in t.collect()]:
        texts.setdefault(i, set()).add(f" {' '.join((name or '').lower().split())} ")
    for i, text in [(r.query_id, r.text) for r in q.collect()]:
        w = (text or "").lower().split()
        run = lambda n: [" ".join(w[j : j + n]) for j in range(len(w) - n + 1)]  # noqa: B023, E731
        for rung, own in enumerate([[" ".join(w)] if w else [], run(3), run(2), [x for x in w if len(x) > 2]]):
            phrases.setdefault(i, [set() for _ in range(4)])[rung].update(own)
    want = {}
    for i, rungs in phrases.items():
        for rung, own in enumerate(rungs):
            hits = [k for k, v in texts.items() if any(f" {p} " in x for p in own for x in v)]
            if hits:
                want[i, rung] = (len(hits), min(hits))
                break
    assert got == want


def test_profile_lines_are_read_once(spark):
    df = spark.createDataFrame([("capacity: 1 L\nCapacity : 2 L\nbogus: x\nmaterials: unknown\nmaterials: a: b",)], "raw string").select(rules.parsed_fields(F.col("raw")).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().split("Project")[1].count("regexp_extract(") == 2
    assert df.first().m == {"capacity": "2 L", "materials": "a: b"}


def test_sections_strip_their_texts_once(spark):
    pages = spark.createDataFrame([(1, 1, "before\n1 SCOPE\n all \n"), (1, 2, " \n　"), (1, 3, None), (2, 1, "no heading ")], "document_id int, page_number int, text string")
    df = chunking.clauses(pages)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert df.columns == ["document_id", "page_number", "text", "section_pos", "section"]
    assert {(r.document_id, r.page_number, r.section, r.text) for r in df.collect()} == {(1, 1, "1", "1 SCOPE\n all"), (2, 1, None, "no heading")}
