"""Byte-level BPE: texts to token ids by a rank file, and back.

A text is split by the vocabulary's pattern, and each piece is merged alone: the leftmost of its adjacent pairs with the least
rank becomes one part, until no pair is in the vocabulary. A segment tree over the piece's byte positions holds the rank
of the pair that starts at each live part; its root is the least rank, the way down to the left finds where, and a merge
changes three leaves: that of the part swallowed, the part's own, and its live left neighbour's. So a piece of m bytes
takes m log m steps, also where it is one long run without a space.

Ids are kept as little-endian unsigned 32-bit numbers in one binary value, as trainers read them from disk. The vocabulary
is read once on the driver and broadcast; its size is checked (`MOST_TOKENS`). Pieces met before come from a memo of
bounded size, which changes the time only.

Defined results: a null text is empty and has no tokens; bytes that are no UTF-8 are read as U+FFFD, as no string
can hold them; special tokens are ordinary text; an id without a token is an error; repeated rows are encoded
alike; an empty table gives an empty table; extra columns stay, and a taken name gets underscores.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Callable, Iterable, MutableSequence

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, text_bytes

#: Tokens that a vocabulary may have; it is broadcast.
MOST_TOKENS = 1_000_000
#: Pieces in each of a worker's two generations of a memo, and the longest of them in characters: at most some 120 MB.
MEMO, MEMO_CHARS = 300_000, 40
#: Characters of a text up to which its pieces are listed at once.
LISTED_CHARS = 1 << 20
NONE = (1 << 31) - 1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """The tokens and ids of a rank file: a line holds a token in base64 and its id."""
    with open(path, "rb") as lines:
        found = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]
    if len(found) > MOST_TOKENS:
        raise ValueError(f"{path} has {len(found)} tokens; at most {MOST_TOKENS} can be broadcast")
    return found


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that are left when no pair can be merged."""
    n = len(piece)
    if n < 2:
        return [piece] if piece else []
    rank = ranks.get
    width = 1 << (n - 2).bit_length()
    after, before = numbers(range(1, n + 1), n, "q"), numbers(range(-1, n - 1), n, "q")
    tree = numbers([NONE], n, "i") * (2 * width)
    for i in range(n - 1):
        tree[width + i] = rank(piece[i : i + 2], NONE)
    for i in range(width - 1, 0, -1):
        left, right = tree[i + i], tree[i + i + 1]
        tree[i] = left if left < right else right
    while (least := tree[1]) != NONE:
        i = 1
        while i < width:  # down to the leftmost leaf of the least rank
            i += i
            if tree[i] != least:
                i += 1
        at, low, high = i - width, i, i
        gone = after[at]
        end = after[at] = after[gone]
        if end < n:
            before[end], high = at, width + gone
            tree[i], tree[high] = rank(piece[at : after[end]], NONE), NONE
        else:
            tree[i] = NONE  # the part swallowed was the last and started no pair
        if at:
            low = width + before[at]
            tree[low] = rank(piece[before[at] : end], NONE)
        while low > 1:  # up from the three leaves, which are at most three tokens apart
            low >>= 1
            high >>= 1
            for i in range(low, high + 1):
                left, right = tree[i + i], tree[i + i + 1]
                tree[i] = left if left < right else right
    out, at = [], 0
    while at < n:
        out.append(piece[at : after[at]])
        at = after[at]
    return out


def numbers(values: Iterable[int], n: int, kind: str) -> MutableSequence[int]:
    """A list for a piece of few bytes, which is fast; an array for one of many, which is small."""
    return list(values) if n <= 4096 else array(kind, values)


class Memo(dict):
    """The packed ids of pieces met lately: the newest, and the generation before them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.codes = ranks, {token: packed([rank]) for token, rank in ranks.items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            data, codes = piece.encode(), self.codes
            found = codes.get(data)  # a piece that is a token as it is isn't merged
            if found is None:
                found = b"".join([codes[x] for x in merged(data, self.ranks)])
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """A vocabulary at work in one process."""

    def __init__(self, tokens: list[tuple[bytes, int]], pattern: str) -> None:
        self.memo = Memo(dict(tokens))
        self.tokens = {rank: token for token, rank in tokens}
        self.split = regex.compile(pattern)

    def encode(self, text: str) -> bytes:
        # the pieces of a very long text are not listed all at once
        pieces = self.split.findall(text) if len(text) <= LISTED_CHARS else (m[0] for m in self.split.finditer(text))
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if ORDER_DIFFERS:
            numbers.byteswap()
        return b"".join(map(self.tokens.__getitem__, numbers))


ORDER_DIFFERS = array("I", [1]).tobytes()[0] != 1


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if ORDER_DIFFERS:
        numbers.byteswap()
    return numbers.tobytes()


class Vocabulary:
    """A rank file and the pattern that splits texts, sent to the executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        self.name, self.pattern, self.tokens = uuid.uuid4().hex, pattern, spark.sparkContext.broadcast(read_ranks(path))

    def _applied(self, column: Column, kind: str, work: Callable[[Encoder, bytes], bytes]) -> Column:
        name, tokens, pattern = self.name, self.tokens, self.pattern

        @F.arrow_udf(kind)
        def run(values: pa.Array) -> pa.Array:
            encoder = encoder_of(name, pattern, tokens)
            return pa.array([work(encoder, x.as_py()) for x in values], pa.binary())

        return run(F.coalesce(column.cast("binary"), F.lit(b"")))

    def encode(self, text: Column) -> Column:
        """The text's ids, packed."""
        return self._applied(text_bytes(text), "binary", lambda encoder, data: encoder.encode(data.decode("utf-8", "replace")))

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for."""
        return self._applied(ids, "binary", lambda encoder, data: encoder.decode(data))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(name: str, pattern: str, tokens: Broadcast) -> Encoder:
    """The process's encoder for the vocabulary of this name; it outlives tasks, and an earlier vocabulary's goes."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(tokens.value, pattern)
    return _ENCODERS[name]


def ids_array(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    digits = lambda i: F.concat(*(F.substring(F.hex(F.substring(ids, 4 * i + 1, F.lit(4))), 2 * b + 1, 2) for b in (3, 2, 1, 0)))
    n = (F.length(ids) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(digits(i), 16, 10).cast("long")))


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with a new binary column: the packed ids of the text."""
    return docs.withColumn(fresh(docs, into), vocabulary.encode(F.col(text)))


def op12(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    rows = encoded(docs.select("doc_id", "text"), vocabulary)
    digest = lambda c: F.sha2(c, 256)
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"),
        digest(vocabulary.decode(F.col("ids"))).alias("decoded_sha256"),
    )
