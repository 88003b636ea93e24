from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from quillspark.llm import graph, simhash
from tests.llm.conftest import corpus


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return Counter((r[0], f"{prints[i]:016x}", min(ids[find(i)], default=None)) for i, r in enumerate(rows))


def test_against_all_pairs(docs):
    rows, _ = corpus()
    assert Counter(tuple(r) for r in simhash.op9(docs).select("doc_id", "fingerprint", "component_id").collect()) == brute(rows)


def test_links_of_crowded_cells(spark):
    """Thousands of fingerprints a few bits apart: components equal those of all pairs."""
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(24) for j in range(24)} | {rng.getrandbits(64) for _ in range(200)}
    chain = 0x0F0F
    for i in range(0, 40, 2):
        chain ^= 3 << i
        prints.add(chain)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    got = {r.node: r.root for r in graph.components(links).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in signed:
        for y in signed:
            if x < y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_keep_one(docs, odd, none):
    rows, _ = corpus()
    names = {k[2] for k in brute(rows)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(names) and {r.doc_id for r in kept.collect()} == names
    assert simhash.keep_one(odd).count() == len(names)
    assert simhash.op9(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(path).collect()} == {(i, 0) for i in range(1, 51)}


@pytest.mark.parametrize("task_edges", [100_000, 150])
def test_rounds_are_small_plans(spark, monkeypatch, task_edges):
    """A round's plans hold no half of it twice, and without hubs over several tasks nothing is broadcast; hubs and paths are whole."""
    plans, make = [], graph.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return make(df)

    monkeypatch.setattr(graph, "stored", kept)
    monkeypatch.setattr(graph, "TASK_EDGES", task_edges)
    hub = [(5, 1000 + i) for i in range(300)] + [(2000 + i, 1000 + i) for i in range(0, 300, 7)]
    path = [(3000 + i, 3001 + i) for i in range(40)] + [(3, 3020), (7, 7), (1000, 5)]
    edges = spark.createDataFrame(hub + path, "a long, b long").repartition(6)
    want = {(b, 5) for _, b in hub} | {(a, 5) for a, _ in hub if a > 5} | {(i, 3) for i in range(3000, 3041)}
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == want
    assert max(p.count("Join ") for p in plans) <= 3
    assert max(p.count("strategy=broadcast") for p in plans) <= 2 * (task_edges == 150)


def test_long_text():
    text = " ".join(str(i) for i in range(70_000))
    a = simhash.simhash(text.encode())
    old, simhash.CHUNK = simhash.CHUNK, 1000
    try:
        assert simhash.simhash(text.encode()) == a
    finally:
        simhash.CHUNK = old


def test_similar_texts_of_many_bits(spark):
    """Links by five-word Jaccard similarity of 0.8 equal those of all pairs, in crowds and chains too."""
    import itertools
    import random

    from quillspark.llm import overlap

    rng = random.Random(3)
    texts, words = [], [f"v{i}" for i in range(5000)]
    for size, copies in ((60, 4), (200, 70), (400, 6), (1500, 3)):
        base = [rng.choice(words) for _ in range(size)]
        for i in range(copies):
            now = list(base)
            for _ in range(i % 7 * size // 150):
                now[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(now))
            if size == 400:
                base = now
    texts += [f"{texts[0]} {x}" for x in words[:3]] + ["one two", "One  two", "one", "", None]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    every = [set(overlap.shingles((t or "").encode()).tolist()) for t in texts]
    prints = [brute_print(t) for t in texts]
    root, far = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        alike, bits = 10 * len(every[i] & every[j]) >= 8 * len(every[i] | every[j]), (prints[i] ^ prints[j]).bit_count()
        far += alike and bits > 2
        if alike or bits <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {find(i) for i in range(len(rows))}
    assert far > 100 and {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == want
    assert simhash.keep_one(docs).count() > len(want)


def test_too_few_rounds(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        graph.components(path, most=1)


def test_crowds_that_are_not_similar_enough(spark, monkeypatch):
    """Texts that share 60 of 90 words meet in bundles, whatever their size, and no pair of texts is made of them."""
    import random

    from quillspark.llm import overlap

    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join(shared + [f"u{rng.randrange(10**9)}" for _ in range(30)]) for _ in range(150)]
    texts += [f"{t} more" for t in texts[:5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for bundle in (128, 7):
        monkeypatch.setattr(overlap, "BUNDLE", bundle)
        for common in (overlap.COMMON, 10**9):  # with no shingle counted as common in the sample, too
            monkeypatch.setattr(overlap, "COMMON", common)
            rows, links = overlap.set_links(docs, 80)
            node = {r.row: r.node for r in rows.collect()}
            found = {frozenset((r.a, r.b)) for r in links.collect()}
            assert len(found) == 5 and len(node) == len(texts)


def test_shared_counts(monkeypatch):
    import numpy as np

    from quillspark.llm import overlap

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype("<u8")) for n in (0, 1, 5, 90, 200, 300)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    for columns in (1 << 15, 7):
        monkeypatch.setattr(overlap, "COLUMNS", columns)
        assert overlap.shared_counts(sets, sets[2:]).tolist() == want


def test_links_of_odd_texts(spark):
    from quillspark.llm import overlap

    none = spark.createDataFrame([], "doc_id long, text string")
    rows, links = overlap.set_links(none, 80)
    assert rows.count() == links.count() == 0
    long = " ".join(f"w{i}" for i in range(120_000))
    odd = [(1, None), (1, None), (2, ""), (3, " \n"), (4, long), (5, long + " end"), (6, "A b"), (7, "a  B")]
    rows, links = overlap.set_links(spark.createDataFrame(odd, "doc_id long, text string"), 80)
    assert links.count() == 2  # the long ones, and those of equal shingles
