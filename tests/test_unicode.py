"""Patterns against Python's re, over white space, digits and letters of any script; folds against plain loops; long inputs."""

import hashlib
import random
import re
import sys
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T
from quillspark.operators import chunking, ingest, safety

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
ORDINALS = "First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth"
PATTERNS = {
    V.STANDARD_NUMBER: re.compile(r"\bIS(?:/[A-Z]+)?\s*\d{2,6}(?:[\s\-:]\d+)?\b"),
    V.EDITION: re.compile(rf"\b({ORDINALS})\s+(Revision|Edition|Reprint)\b", re.IGNORECASE),
    V.YEAR: re.compile(r"\b(19[5-9]\d|20\d\d)\b"),
    V.HEADING_PARTS: re.compile(r"^(\d+(?:\.\d+)*)\s+([A-Z][A-Za-z0-9 ,\-/&()]{2,80})$", re.MULTILINE),
    V.TITLE_END: re.compile(rf"^\(?\s*({ORDINALS})\s+(Revision|Edition|Reprint)\s*\)?$|^ICS\b|^©|^\d+(\.\d+)*\s+[A-Z]", re.IGNORECASE),
    V.FILE_STANDARD_NUMBER: re.compile(r"(?:^|[^a-z0-9])is[._\-\s]*(\d{2,6})", re.IGNORECASE),
    "(?dm)" + V.SCOPE_LINE: re.compile(r"^\d+(?:\.\d+)*[ \t]+SCOPE[ \t]*$|^SCOPE[ \t]*$", re.MULTILINE | re.IGNORECASE),
}


def made_up(n=2500, seed=3):
    rng = random.Random(seed)
    parts = ["IS", "is", "/ISO", "302", "1", "2019", "1998", "४५६", "٣", "½", "First", "tenth", "Revision", "edition", "Reprint", "SCOPE", "Scope", "General Notes", "ICS", "©", "(", ")", ".", "-", ":", "_", "é", "a", "Z", "中"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice([*SPACES, "\n", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    texts += [f"1{s}SCOPE" for s in SPACES] + [f"First{s}Revision" for s in SPACES] + [f"IS{s}302{s}1" for s in SPACES]
    return [t for t in texts if "\r" not in t and "\x85" not in t and "\u2028" not in t and "\u2029" not in t]  # the ends of lines have their own rules


def test_patterns(spark):
    texts = made_up()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = df.select("i", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"p{k}") for k, p in enumerate(PATTERNS))).collect()
    found = 0
    for r in got:
        for k, pattern in enumerate(PATTERNS.values()):
            want = [m[0] for m in pattern.finditer(texts[r.i])]
            assert r[f"p{k}"] == want, (pattern.pattern, texts[r.i])
            found += len(want)
    assert found > 300


def test_strip(spark):
    texts = [f"{a}x{b}y{b}{a}" for a in SPACES for b in SPACES[::5]] + ["", *SPACES]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_headings_behind_any_space(spark):
    pages = spark.createDataFrame([(f"d{i}", 1, f"before\n1{s}SCOPE\nThis one.\n2.1{s}General Notes\nMore.") for i, s in enumerate(SPACES) if s not in "\n\r\x0b\x0c\x85\u2028\u2029"], "document_id string, page_number int, text string")
    rows = chunking.sections(pages).collect()
    assert {(r.section, r.text.split("\n")[-1]) for r in rows} == {(None, "before"), ("1", "This one."), ("2.1", "More.")}
    assert len(rows) == 3 * pages.count() and chunking.clauses(pages).count() == 2 * pages.count()
    assert {r.value for r in chunking.heading_features(pages).collect()} == {"1 SCOPE", "2.1 General Notes"}


def packed(paragraphs, most, overlap, sep):
    out, now = [], ""
    for p in paragraphs:
        joined = now + sep + p if now else p
        if not now or len(joined) <= most:
            now = joined
        else:
            out.append(now)
            now = (now[-overlap:] if overlap else "") + sep + p
    return out + [now] if now else out


@pytest.mark.parametrize("most, overlap, sep", [(800, 100, "\n\n"), (40, 10, "\n\n"), (12, 12, " "), (5, 0, "--"), (30, 29, "")])
def test_packing(spark, monkeypatch, most, overlap, sep):
    monkeypatch.setattr(chunking, "PACK_BLOCK", 7)
    rng = random.Random(most)
    rows = [(i, ["x" * rng.choice([1, 2, 3, 9, 30, most, most + 1]) + rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 6, 7, 8, 50]))]) for i in range(40)]
    got = spark.createDataFrame(rows, "i int, p array<string>").select("i", chunking.pack(F.col("p"), most, overlap, sep).alias("c")).collect()
    assert all(r.c == packed(rows[r.i][1], most, overlap, sep) for r in got)


def test_folds_are_linear(spark):
    def seconds(n):
        df = spark.createDataFrame([("p " * 40 + f"{i}",) for i in range(n)], "t string").agg(F.collect_list("t").alias("p")).checkpoint()
        took = []
        for column in (F.size(chunking.pack(F.col("p"))), F.length(safety.trimmed(F.array_join("p", ". ")))):
            began = time.perf_counter()
            assert df.select(column.alias("n")).first().n > 0
            took.append(time.perf_counter() - began)
        return took

    from quillspark.session import shared_dir

    shared_dir(spark)
    seconds(100)
    small, large = seconds(10_000), seconds(40_000)
    assert all(b < 8 * a + 2 for a, b in zip(small, large)), (small, large)


def test_table_blocks(spark):
    rows = [["a", " b\u00a0"], [None, "c"]]
    block = "[TABLE]\na | b\n | c\n[/TABLE]"
    cases = [
        ("x a b c y a b c", [("\n a b c ", rows)], f"x {block} y a b c"), ("none here", [("a b", rows)], "none here"), ("a b", [("a b", [])], "a b"), ("a b", [(" ", rows)], "a b"),
        ("t1 and t2", [("t1", rows), ("t2", [["z"]])], f"{block} and [TABLE]\nz\n[/TABLE]"), ("as it is", None, "as it is"), ("", [("a", rows)], ""), ("a", [(None, rows), ("a", None)], "a"),
    ]
    df = spark.createDataFrame([(t, tables, want) for t, tables, want in cases], "t string, tables array<struct<flat:string,rows:array<array<string>>>>, want string")
    assert [r.got for r in df.select("want", T.with_table_blocks(F.col("t"), F.col("tables")).alias("got")).collect()] == [c[2] for c in cases]


def test_a_content_of_many_rows_stays_where_it_is(spark, monkeypatch):
    rows = [(i, "blank" if i % 3 else f"text {i % 10}", i % 2) for i in range(300)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "id int, content string, first_ int")
    found = [ingest.first_by_content(df, "content", "id")]
    monkeypatch.setattr(ingest, "HOT_ROWS", 5)
    found.append(ingest.first_by_content(df, "content", "id"))
    first = {}
    for i, c, _ in rows:
        if i is not None:
            first[c] = min(first.get(c, i), i)
    sha = lambda c: None if c is None else hashlib.sha256(c.encode()).hexdigest()
    want = sorted(((i, sha(c), first.get(c)) for i, c, _ in rows), key=repr)
    for f in found:
        assert sorted(((r.id, r.content_hash, r.first) for r in f.collect()), key=repr) == want
