"""The question flows end to end, on a few small documents."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.operators import prompts
from quillspark.plans import discovery

PAGES = [
    ("d1", 1, "1 SCOPE\nThis standard covers the storage water heater.\n2 MARKING\nEach storage water heater shall be marked and tested to IS 302."),
    ("d2", 1, "1 SCOPE\nConcrete bars and cement."), ("d3", 1, "A water heater note on copper."), ("gone", 1, "orphan water heater"),
]
DOCS = [("d1", "heater.pdf", "INDIAN_STANDARD", "s1"), ("d2", "concrete.pdf", "QCO", "s2"), ("d3", "note.pdf", "OTHER", None)]
FIELDS = ",".join(f"{f} string" for f in V.PROFILE_FIELDS)


@pytest.fixture(scope="module")
def world(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, text string")
    return discovery.index(pages).cache(), spark.createDataFrame(DOCS, "document_id string, document_name string, document_type string, standard_id string")


def profile(**given):
    return [given.get(f) for f in V.PROFILE_FIELDS]


def test_retrieve(spark, world):
    chunks, docs = world
    asked = spark.createDataFrame(
        [("a", "heater", None, None), ("b", "heater", "d2", None), ("c", "heater", None, "s1"), ("e", "heater", None, "none")],
        "query_id string, text string, document_id string, standard_id string"
    )
    free = asked.drop("document_id", "standard_id")
    rows = discovery.retrieve(free, chunks, docs, top_k=10).collect()
    assert {r.document_id for r in rows} == {"d1", "d2", "d3"} and {r.document_name for r in rows} == {"heater.pdf", "concrete.pdf", "note.pdf"}
    few = discovery.retrieve(asked, chunks, docs, top_k=10).collect()
    by = {}
    for r in few:
        by.setdefault(r.query_id, set()).add(r.document_id)
    assert by == {"a": {"d1", "d2", "d3"}, "b": {"d2"}, "c": {"d1"}}
    typed = discovery.retrieve(free, chunks, docs, types=["QCO"]).collect()
    assert {r.document_id for r in typed} == {"d2"} and discovery.retrieve(free, chunks, docs, types=[]).count() == 0
    with pytest.raises(Exception, match="exclude each other"):
        discovery.linked(asked.withColumn("document_id", F.lit("d1")).withColumn("standard_id", F.lit("s1")), docs).collect()


def test_discover(spark, world):
    chunks, docs = world
    full = profile(
        product_category="water_heater", product_type="storage", intended_use="domestic", electrical_characteristics="230V",
        capacity="25 L", technology="element", materials="copper"
    )
    rows = [
        ("p", "which test method", *full), ("q", None, *profile(product_name="cement")), ("none", "hello", *profile()),
        ("id", "see IS 302 please", *profile())
    ]
    profiles = spark.createDataFrame(rows, f"query_id string, user_query string, {FIELDS}")
    assert {r.query_id: r.text for r in discovery.asked_of(profiles).select("query_id", "text").collect()} == {
        "p": "water_heater storage element storage water_heater domestic water_heater element water_heater 25 L 230V copper", "q": "cement", "id": "IS 302"}
    assessed, open_, lists = discovery.discover(profiles, chunks, docs)
    found = {(r.query_id, r.document_id): r for r in assessed.collect()}
    assert {q for q, _ in found} == {"p", "q", "id"}
    best = found["p", "d1"]
    assert best.document_type_boost == 1 and best.profile_attribute_boost == 1 and best.applicability_status == "POTENTIALLY_APPLICABLE"
    assert found["q", "d2"].matched_terms == ["cement"] and found["id", "d1"].exact_identifier_boost == 1
    asked = {r.query_id: len(r.questions) for r in open_.collect()}
    assert asked == {"p": 0, "q": 1, "none": 1, "id": 1}
    items = {r.query_id: [(x.category, x.status) for x in r["items"]] for r in lists.collect()}
    assert set(items) == {"p"} and ("MARKING", "POTENTIALLY_APPLICABLE") in items["p"] and ("TESTING", "POTENTIALLY_APPLICABLE") in items["p"]


def test_request_checks(spark):
    rows = [("q", 5), ("  ", 5), ("x" * 1001, 5), ("q", 0), ("q", 21), (None, 1)]
    got = [r.p for r in spark.createDataFrame(rows, "q string, k int").select(discovery.query_problem(F.col("q"), F.col("k")).alias("p")).collect()]
    assert got == [None, "empty", "too long", "top_k out of range", "top_k out of range", "empty"]
    rows = [("m", "en", None), ("m", "fr", None), ("m", None, "chat"), ("m" * 4001, None, None), ("m", "hi", "product_discovery")]
    got = [
        r.p for r in spark.createDataFrame(rows, "m string, l string, o string").select(
            discovery.message_problem(F.col("m"), F.col("l"), F.col("o")).alias("p")
        ).collect()
    ]
    assert got == [None, "unsupported language", "unsupported mode", "too long", None]
    rows = [("u", "12"), (" ", "12"), ("u", "1a"), ("u", "123")]
    assert [
        r.p for r in spark.createDataFrame(rows, "u string, p string").select(discovery.user_problem(F.col("u"), F.col("p")).alias("p")).collect()
    ] == [None, "blank name", "bad pin", "bad pin"]


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    blank = {f: F.lit(None).cast("string") for f in V.PROFILE_FIELDS}
    assert one(prompts.profile_summary(blank)) == "PRODUCT PROFILE: (nothing established yet)"
    assert one(
        prompts.profile_summary(blank | {"capacity": F.lit("2 L"), "product_name": F.lit("X")})
    ) == "PRODUCT PROFILE (known so far):\n- Product name: X\n- Capacity: 2 L"
    asked = F.expr("array(named_struct('question', 'A?'), named_struct('question', 'B?'))")
    assert one(prompts.questions_block(asked)) == "CLARIFICATION QUESTIONS TO ASK THE USER:\n1. A?\n2. B?"
    found = F.expr("array(named_struct('document_name', 'd.pdf', 'status', 'NEEDS_CLARIFICATION', 'reason', 'why'))")
    need = F.expr("array(named_struct('category', 'MARKING', 'title', 'T', 'status', 'CONFIRMED', 'regulatory_status', 'NOT_DETERMINED', 'description', 'D'))")
    none = F.expr("filter(array(named_struct('question', 'x')), q -> false)")
    assert one(prompts.structured_answer(asked, found, need)) == (
        "To help identify relevant requirements, could you clarify:\n1. A?\n2. B?\n\nBased on retrieved evidence so far:\n- d.pdf: Needs Clarification — why\n\n"
        "Potential requirements identified from retrieved evidence:\n- [Marking] T (Confirmed)\n\nMandatory/regulatory status could not be determined from available evidence for any of the above."
    )
    empty = lambda x: F.filter(x, lambda _: F.lit(False))
    assert one(prompts.structured_answer(none, empty(found), empty(need))).startswith("I don't have enough retrieved evidence yet")
    assert one(prompts.checklist_block(need)) == "REQUIREMENTS CHECKLIST:\n- [MARKING] T — STATUS: CONFIRMED, REGULATORY STATUS: NOT_DETERMINED\n  D"


def test_plain_turns(spark):
    from quillspark.functions import fixed_values as V
    from quillspark.operators.embedding import hashed_gram_embedder

    pages = spark.createDataFrame([("D1", 1, "1 SCOPE\nIS 302 covers water heaters and geysers.")], "document_id string, page_number int, text string")
    documents = spark.createDataFrame([("D1", "d.pdf", "OTHER", None)], "document_id string, document_name string, document_type string, standard_id string")
    embed = hashed_gram_embedder()
    asked = spark.createDataFrame([(1, "Which water heaters and geysers"), (2, "Laptops, batteries and chairs"), (3, "water heaters")], "query_id int, text string")
    said = "IS 302 says so, see IS 999. Generally, IS 1 is asked for."
    answers = spark.createDataFrame([(1, said), (2, said)], "query_id int, answer string")
    got = {r.query_id: r for r in discovery.plain_turns(asked, answers, discovery.index(pages, embed), documents, embed).collect()}
    assert set(got) == {1, 2}
    assert not got[1].off_corpus and got[1].unverified == ["IS 999"] and got[1].content.startswith(said + V.UNVERIFIED_NOTE + "IS 999")
    assert got[2].off_corpus and got[2].content.startswith("IS 302 says so, see IS 999.\n\n" + V.TRIM_NOTICE) and len(got[2].citations) == 1
    none = {r.query_id: r for r in discovery.plain_turns(asked, answers, discovery.index(pages.limit(0), embed), documents, embed).collect()}
    assert none[1].citations == [] and not none[1].off_corpus and none[1].unverified == ["IS 302", "IS 999"]


def test_chunks_of_the_question_flows_are_made_once_and_stay_in_their_tasks(spark):
    from quillspark.operators import search
    from quillspark.plans import rule_queries

    chunks, documents = rule_queries.world(spark, "/root/testdata/sf0.001")
    assert chunks.inputFiles() and all("/chunks-" in f for f in chunks.inputFiles())
    asked = spark.createDataFrame([(1, [0.1] * 8)], "query_id long, query_vector array<double>")
    found = search.vector_top_k(asked, chunks, 3, key="chunk_id", parents=documents)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
