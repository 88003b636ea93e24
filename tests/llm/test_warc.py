import hashlib
from collections import Counter, defaultdict

import pytest

from quillspark.llm import warc

ROWS = [(i, f"http://x/{i}", ("<p>page %d</p>" % (i % 7)) * (1 + 12 * (i % 3 != 1))) for i in range(60)] + [
    (100, None, None), (101, "http://é/\r\nx", ""), (102, "http://y", "é" * 50), (103, "http://z", "é" * 50), (104, "u", "é" * 49), (105, "u", "é" * 49),
    (None, "nobody", "é" * 50), (102, "http://y", "é" * 50), (106, "big", "x" * 2_000_000),
]


def brute():
    by = defaultdict(list)
    for i, _, h in ROWS:
        by[h or ""].append(i)
    out = Counter()
    for i, _, h in ROWS:
        data = (h or "").encode()
        first = min((x for x in by[h or ""] if x is not None), default=None)
        revisit = len(data) >= 100 and i != first
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").repartition(4)


def test_digest(pages):
    assert Counter(tuple(r) for r in warc.op2(pages).collect()) == brute()
    assert warc.op2(pages.limit(0)).count() == 0


def test_records_come_back(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    by = {(i, k): data for i, _, h in ROWS for k, data in (("response", (h or "").encode()), ("revisit", b""))}
    got = warc.read_records(spark, path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == by[r.page_id, r.kind] and int(fields[b"Content-Length"]) == len(body) - 4
        assert (b"WARC-Refers-To" in fields) == (r.kind == "revisit")


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="payload damaged"):
        warc.read_payloads(spark, path).collect()


def test_text_ids(spark, tmp_path):
    rows = [("b/2", "http://x", "y" * 200), ("a 1", None, "y" * 200), ("ü", "http://z", None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op2(df).collect()}
    assert got == {"a 1": ("response", None), "b/2": ("revisit", "a 1"), "ü": ("response", None)}
    warc.write_archive(df, f"{tmp_path}/a")
    assert {r.page_id for r in warc.read_records(spark, f"{tmp_path}/a", "string").collect()} == {"b/2", "a 1", "ü"}
