"""The pipeline against a brute-force version of its stages."""

import math
import re
import struct
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_runs, test_simhash
from tests.llm.conftest import DOCS, corpus
from tests.llm.test_mixing import brute_targets


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    count = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = re.findall(r"[A-Za-z\u0080-\U0010ffff]", text or "")
    upper = re.findall(r"[A-Z]", text or "")
    letter_bytes = len("".join(letters).encode())
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or 100 * len(re.findall(r"[#*$%&|<>]", text or "")) > 20 * n
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 100 * len(upper) > 50 * letter_bytes
        or 100 * sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", w)) for w in words) < 60 * n
        or 100 * max(Counter(words).values(), default=0) > 40 * n or not 2 * n <= sum(map(len, words)) <= 15 * n
    )


def brute_mix(rows):
    """(doc_id, copies, taken) of what is taken: duals by bisection, copies by carrying the rounding error from large to small."""
    size = lambda r: len((r[1] or "").encode().split())
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sizes = {s: sum(map(size, rs)) for s, rs in by.items()}
    targets, out = brute_targets(sizes), Counter()
    for source, rs in by.items():
        total, target = sizes[source], targets[source]
        docs = sorted((r for r in rs if size(r)), key=lambda r: (-size(r), signed(r[0]), r[0]))
        rate = lambda n, dual: min(2.0, math.exp(min(50.0, dual * n * len(docs) / total)))
        low, high = -200.0, 200.0
        for _ in range(300):
            dual = (low + high) / 2
            low, high = (low, dual) if sum(size(r) * rate(size(r), dual) for r in docs) > target else (dual, high)
        cells = defaultdict(list)
        for r in docs:
            cells[size(r)].append(r)
        error = 0.0
        for n, members in cells.items():
            each = 2.0 if target >= 2 * total * (1 - 1e-9) else rate(n, dual)
            want = len(members) * each + error / n
            copies = int(min(2 * len(members), max(0, want + 0.5)))
            error = (want - copies) * n
            for i, r in enumerate(members):
                own = copies // len(members) + (i < copies % len(members))
                if own:
                    out[r[0], own, own * n] += 1
    return out


def signed(doc):
    h = xxh64_intdigest(struct.pack("<q", doc), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows, passage = corpus(11, 400)
    rows = [r for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    items = [("b1", passage[:120]), ("b2", "w1 w2 w3"), ("b3", rows[40][1])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items, str(path)


def brute_stages(rows, items):
    """The rows after each stage but the last."""
    rows = [r for r in rows if brute_quality(r[1])]
    yield rows
    texts = {k[0]: k[3] for k in test_line_runs.brute(rows)}
    rows = [(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in rows]
    yield rows
    names = {k[0] for k in test_simhash.brute(rows) if k[0] == k[2]}
    rows = [r for r in rows if r[0] in names]
    yield rows
    clean = {k[0] for k in test_decontaminate.brute(rows, items) if not k[5]}
    rows = [r for r in rows if r[0] in clean]
    yield rows


def test_stages_and_run(spark, world):
    rows, items, path = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(rows, items), strict=False):
        docs = stage(spark, docs, path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want), name
    assert 10 < len(want) < len(rows)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.copies, r.taken) for r in got) == brute_mix(want)
    assert all(r.text == {x[0]: x[1] for x in want}[r.doc_id] for r in got)


def test_odd_inputs(spark, odd, none, world):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, world[2]).count() == 0, name
        out = stage(spark, odd, world[2])
        assert set(odd.columns) <= set(out.columns) and out.count() <= odd.count(), name


def test_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
