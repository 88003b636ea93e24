import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import quality
from tests.llm.conftest import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_counts_and_base(docs):
    rows, _ = corpus()
    want = Counter((d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for d, t, *_ in rows for b in [brute(t)])
    got = quality.quality_report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_order_changes_no_verdict(docs):
    rules = quality.default_rules()
    names = [r.name for r in rules]
    both = docs.select(
        "doc_id", quality.cascade(F.col("text"), rules, names)["kept"].alias("a"),
        quality.cascade(F.col("text"), rules, names[::-1])["kept"].alias("b")
    )
    assert both.where("a != b").count() == 0
    profile = quality.rule_profile(docs, rules)
    assert sorted(quality.cascade_order(profile)) == sorted(names)
    assert all(0 <= share <= 1 and cost >= 0 for _, cost, share in profile)


def test_order_is_rejection_per_cost():
    assert quality.cascade_order([("slow", 10.0, 0.5), ("fast", 1.0, 0.1), ("none", 0.1, 0.0)]) == ["fast", "slow", "none"]


def test_edges(none, odd):
    assert quality.quality_report(none).count() == 0
    assert quality.quality_report(odd).count() == odd.count()
    kept = quality.quality_filter(odd.drop("quality"), into="quality")
    assert set(odd.columns) <= set(kept.columns)


def test_clean_prose_stays_and_junk_goes(spark):
    clean = " ".join(f"Wort{chr(97 + i % 26)}{chr(97 + i % 7)} über{chr(97 + i % 19)}" for i in range(60))
    rows = [
        (1, clean), (2, "A!! " + "SHOUT!! ".join(f"X{chr(65 + i % 26)}{chr(65 + i % 5)} " for i in range(80))),
        (3, clean.replace(" ", "*** ")), (4, "no " * 200), (5, None), (6, "x " * 5_000_00)
    ]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_a_taken_name(spark):
    row = quality.quality_filter(spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, quality int")).first()
    assert row.quality == 7 and row.quality_.kept is False
