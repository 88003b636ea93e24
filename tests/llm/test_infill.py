"""Fill-in-middle against a plain version, and its exact way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import infill

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 511, 512, 513, infill.PIECE - 1, infill.PIECE, infill.PIECE + 1])
def test_select(length):
    rng = random.Random(length)
    for data in (bytes(rng.choice(b"ab \n\t\xc3\xa9") for _ in range(length)), b" " * length, b"x" * length):
        wanted = [m.end() for m in re.finditer(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", data)]
        ends = infill.UnitEnds(data)
        assert ends.total == len(wanted)
        ranks = range(len(wanted) + 1) if length < 2000 else {0, 1, 2, len(wanted) // 2, len(wanted), *(rng.randint(0, len(wanted)) for _ in range(200))} - {-1}
        assert all(ends.select(k) == (wanted[k - 1] if k else 0) for k in ranks if k <= len(wanted))


def rows_of(docs):
    return docs.select("doc_id", "text").collect()


def test_against_plain_version(docs):
    made = infill.fill_in_middle(docs, into="f").select("doc_id", "text", "f.*").collect()
    assert len(made) == docs.count()
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_digests_and_way_back(docs):
    got = sorted(map(tuple, infill.op13(docs).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(r.doc_id, *(v := plain_version(r.doc_id, r.text))[:4], sha(v[4]), sha(r.text or "")) for r in rows_of(docs)]
    assert got == sorted(want, key=repr)


def test_odd_texts(spark):
    texts = [
        "", None, " ", "\n", "a", " a", "a ", "<", "<P", "P><S", "a <S", "<M> in it", "S> M> P>", "<< >> <S <P <M", "é　ü x", "    z",
        "😀 " * 50, "x" * 3_000_000, ("word " * 200_000) + "end \n", "\x00 \x1f", "<S\nP>", "a<", "<P", ">",
    ]
    df = spark.createDataFrame([(i + 100 * k, t) for i, t in enumerate(texts) for k in range(8)], "doc_id long, text string").repartition(8)
    for r in infill.fill_in_middle(df, into="f").select("*", infill.restored(F.col("f.output"), F.col("f.form")).alias("again")).collect():
        assert tuple(r.f) == plain_version(r.doc_id, r.text), r.doc_id
        assert r.again == (r.text or "")


def test_everything_can_be_transformed(docs):
    made = infill.fill_in_middle(docs, percent=100, spm_percent=0).select("text", "infill.form").collect()
    assert {r.form for r in made if r.text and "<" not in r.text} == {"psm"}


def test_extra_columns_and_empty(odd, none):
    assert infill.fill_in_middle(odd.withColumn("infill", F.lit(1)).withColumn("infill_cuts", F.lit(2))).columns == [*odd.columns, "infill", "infill_cuts", "infill_"]
    assert infill.op13(none).count() == 0
    assert infill.op13(odd).count() == odd.count()
