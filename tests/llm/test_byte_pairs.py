"""Byte-level BPE against the library of the rank files, against plain merging, and back."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillspark.llm import byte_pairs

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return byte_pairs.Encoder(ranks, tokenizers.PATTERN)


def merged(piece, ranks):
    """One merge at a time, over all pairs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tree_against_plain_merging():
    rng = random.Random(3)
    for _ in range(300):
        letters = b"ab" if rng.random() < 0.5 else b"abcd"
        tokens = {bytes([x]) for x in letters}
        for _ in range(rng.randint(0, 12)):
            tokens.add(rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))
        order = sorted(tokens, key=lambda _: rng.random())
        ranks = {t: i for i, t in enumerate(order)}
        piece = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert byte_pairs.merged(piece, ranks) == merged(piece, ranks)


def test_against_library(encoder, library, docs):
    rng = random.Random(4)
    texts = [r.text or "" for r in docs.select("text").collect()]
    alphabet = ["a", "e", "  ", "\n", "1", "'s", "'", "É", "ß", "漢", "😀", " ", " ", "\x00", "\x1c", "<|endoftext|>", "-", "\t", "th", "ing"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["x" * 20_000, "ab" * 5_000, " " * 9_999 + "a", "ñ" * 4_000, "<|endoftext|>", "".join(rng.choice("abcdefghij") for _ in range(30_000))]
    for t in texts:
        data = encoder.encode(t)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == library.encode_ordinary(t)
        assert encoder.decode(data) == t.encode()


def test_a_piece_that_is_a_token_is_not_merged():
    tokens = [(b"a", 0), (b"b", 1), (b"c", 2), (b"abc", 3)]  # no pair leads to abc
    encoder = byte_pairs.Encoder(tokens, tokenizers.PATTERN)
    assert encoder.encode("abc") == struct.pack("<I", 3) and encoder.encode("abca") == struct.pack("<4I", 0, 1, 2, 0)


def test_memo_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "MEMO", 7)
    encoder = byte_pairs.Encoder(ranks, tokenizers.PATTERN)
    text = " ".join(f"w{i % 30}" for i in range(500))
    assert encoder.encode(text) == byte_pairs.packed(library.encode_ordinary(text)) and len(encoder.memo) <= 7 and len(encoder.memo.older) <= 7


def test_query(docs, library):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((r.text or "").encode())))
    assert sorted(map(tuple, byte_pairs.op12(docs, PATH, tokenizers.PATTERN).collect()), key=repr) == sorted(want, key=repr)


def test_ids_as_numbers_and_odd_inputs(spark, library, odd, none):
    vocabulary = byte_pairs.Vocabulary(spark, PATH, tokenizers.PATTERN)
    texts = ["", None, "a b c", "naïve 😀\n\n x", "word " * 30_000]
    df = byte_pairs.encoded(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary)
    for r in df.select("text", byte_pairs.ids_array(F.col("ids")).alias("n"), vocabulary.decode(F.col("ids")).alias("again")).collect():
        assert bytes(r.again).decode() == (r.text or "")
        assert r.n == library.encode_ordinary(r.text or "")
    bad = spark.createDataFrame([(bytearray(b"a\xff"),)], "b binary").select(F.col("b").cast("string").alias("text"))
    assert byte_pairs.op12(bad.withColumn("doc_id", F.lit(1)), PATH, tokenizers.PATTERN).count() == 1
    assert byte_pairs.encoded(odd.withColumn("ids", F.lit(1)), vocabulary).columns[-1] == "ids_"
    assert byte_pairs.op12(none, PATH, tokenizers.PATTERN).count() == 0


def test_unknown_id_is_an_error(spark):
    vocabulary = byte_pairs.Vocabulary(spark, PATH, tokenizers.PATTERN)
    with pytest.raises(Exception, match="KeyError"):
        spark.range(1).select(vocabulary.decode(F.unhex(F.lit("FFFFFF7F")))).collect()


def test_too_many_tokens(monkeypatch):
    monkeypatch.setattr(byte_pairs, "MOST_TOKENS", 10)
    with pytest.raises(ValueError, match="at most 10"):
        byte_pairs.read_ranks(PATH)
