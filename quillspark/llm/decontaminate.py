"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of `window` words, windows into shingles of
`shingle` words. A document can hold a window only if it holds all its shingles,
so for each window the join needs a prefix of one: its rarest shingle, by counts
over all documents. Documents are matched with windows on that shingle; the
window's length and the shingle's place in it bound the positions; what is left
is verified word by word.

A bitmap of fixed size (at most `MAX_BITS`) keeps shingles that no window has from
leaving the scan; it may pass too many and never drops one that matters, and the
join behind it is exact at any benchmark size.

Defined results: a null text has no words and is clean; an item without words is
ignored; a null item id counts as the empty string; repeated rows of documents
get equal results, repeated items count once by id; an empty table of either kind
gives no hits; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import cut, fresh, row_key, text_bytes

WINDOW = 10
SHINGLE = 3
MAX_BITS = 1 << 27
#: Windows (some 300 bytes each) up to which their table is broadcast; above, the join shuffles.
BROADCAST_WINDOWS = 100_000
CHUNK_BYTES = 1 << 20

WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit names of all runs of size words, from the words' own hashes."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words (joined by a space), n, shingles (their hashes in order) of every distinct window of every item."""

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(data)
                n = min(window, len(words))
                names = shingle_hashes(word_hashes(words), min(shingle, n)).view(np.int64).tolist() if n else []
                inner = n - min(shingle, n) + 1
                out = {tuple(words[i : i + n]): names[i : i + inner] for i in range(len(words) - n + 1)} if n else {}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(out), pa.string()), pa.array([b" ".join(x) for x in out], pa.binary()), pa.array([n] * len(out), pa.int32()), pa.array(list(out.values()), pa.list_(pa.int64()))],
                    ["item_id", "words", "n", "shingles"],
                )

    columns = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_bytes(F.col("text")).alias("data")
    return items.select(*columns).mapInArrow(cut_windows, "item_id string, words binary, n int, shingles array<long>")


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits set at the hashes' places; 16 bits a hash, as far as MAX_BITS goes. It is the only thing sent to all executors."""
    n = hashes.count()
    bits = 1 << 16
    while bits < min(MAX_BITS, 16 * n):
        bits *= 2
    at = F.pmod(F.col(column), F.lit(bits))
    pages = hashes.groupBy(F.expr(f"pmod({column}, {bits}) div 32768").alias("page")).agg(F.bitmap_construct_agg(at % 32768).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for page in pages:
        out[page["page"] * 4096 : (page["page"] + 1) * 4096] = np.frombuffer(bytes(page["bits"]), np.uint8)
    return out


def passing(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = names.view(np.int64) % np.int64(8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the last column holds about size bytes; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum([len(x.as_buffer()) for x in batch.column(batch.num_columns - 1)], dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def matches_in(texts: list[bytes], sizes: list[int], bits: np.ndarray) -> tuple[list[bytes], np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
    """All words, each text's first word (and the end), and by shingle size the places and names that pass."""
    split = [words_of(x) for x in texts]
    words = [w for x in split for w in x]
    starts = np.cumsum([0, *map(len, split)])
    own, hashes = np.repeat(np.arange(len(split)), np.diff(starts)), word_hashes(words)
    found = []
    for size in sizes:
        names = shingle_hashes(hashes, size)
        at = np.flatnonzero(passing(names, bits)) if len(names) else np.zeros(0, np.int64)
        at = at[own[at] == own[at + size - 1]] if len(at) else at
        found.append((at, names[at], size))
    return words, starts, found


def shingle_counts(docs: DataFrame, text: Column, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """name, freq over all documents, of the shingles that pass."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, _, found = matches_in(batch.column(0).to_pylist(), sizes, held.value)
            names, n = np.unique(np.concatenate([x[1] for x in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "freq"])

    return docs.select(text_bytes(text).alias("data")).mapInArrow(count, "name long, freq long").groupBy("name").agg(F.sum("freq").alias("freq"))


def candidates(docs: DataFrame, doc_id: str, text: str, sizes: list[int], bits: np.ndarray, window: int) -> DataFrame:
    """A row a document: key, doc_id, n_words, found: where a prefix shingle may be, with the words around it."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    place = pa.struct([("at", pa.int32()), ("name", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, starts, found = matches_in(batch.column(2).to_pylist(), sizes, held.value)
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for at, names, _ in found:
                for i, name, doc in zip(at.tolist(), names.view(np.int64).tolist(), (np.searchsorted(starts, at, side="right") - 1).tolist(), strict=True):
                    first, last = int(starts[doc]), int(starts[doc + 1])
                    before, after = words[max(first, i - window + 1) : i], words[i : min(last, i + window)]
                    rows[doc].append({"at": i - first, "name": name, "before": b" " + b" ".join(before), "after": b" ".join(after) + b" "})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts), pa.int64()), pa.array(rows, pa.list_(place))],
                ["key", "doc_id", "n_words", "found"]
            )

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), text_bytes(F.col(text)).alias("data"))
    return rows.mapInArrow(scan, f"key binary, doc_id {kind}, n_words long, found array<struct<at:int,name:long,before:binary,after:binary>>")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: key (its row_key), doc_id, n_words, spans (start, end of each window's occurrence, in words), items (ids, sorted)."""
    cuts = cut(benchmark_windows(items, window, shingle))
    sizes = sorted(r["s"] for r in cuts.select(F.least("n", F.lit(shingle)).alias("s")).distinct().collect()) or [shingle]
    names = cut(cuts.select(F.explode("shingles").alias("name")).distinct())
    freq = shingle_counts(docs, F.col(text), sizes, bitmap(names, "name"))
    placed = cuts.select("words", "n", "shingles").dropDuplicates(["words"]).select("words", "n", F.posexplode("shingles").alias("off", "name"))
    # a window with a shingle that no document has cannot occur: its rarest shingle then has no count
    rare = placed.join(freq, "name", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "name", "off")).alias("p"))
    split = F.split(F.col("words").cast("string"), " ", -1)
    windows = cut(
        rare.where("p.freq > 0").select(
            "words",
            "n",
            "p.name",
            "p.off",
            F.when(F.col("p.off") > 0, F.concat(F.lit(" "), F.array_join(F.slice(split, F.lit(1), F.col("p.off")), " "))).otherwise("").cast("binary").alias("head"),
            F.concat(F.array_join(F.slice(split, F.col("p.off") + 1, F.col("n")), " "), F.lit(" ")).cast("binary").alias("tail"),
        )
    )
    n = windows.count()
    rows = cut(candidates(docs, doc_id, text, sizes, bitmap(windows.select("name").distinct(), "name"), window))
    places = rows.select("key", "n_words", F.explode("found").alias("f")).select("key", "n_words", "f.*").distinct()
    fits = (F.col("at") >= F.col("off")) & (F.col("n_words") - F.col("at") >= F.col("n") - F.col("off"))
    exact = F.endswith("before", "head") & F.startswith("after", "tail")
    start = F.col("at") - F.col("off")
    found = places.join(F.broadcast(windows) if n <= BROADCAST_WINDOWS else windows, "name").where(fits & exact).select(
        "key", "words", start.alias("start"), (start + F.col("n")).alias("end")
    )
    found = cut(found)
    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    owners = cuts.select("words", "item_id").distinct()
    named = found.select("key", "words").distinct().join(owners, "words").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return rows.drop("found").join(spans.join(named, "key"), "key", "left")


def covered(spans: str) -> Column:
    """How many words the sorted spans cover."""
    return F.coalesce(
        F.expr(f"aggregate({spans}, struct(0L as total, 0L as reach), (a, s) -> struct(a.total + greatest(0L, s.end - greatest(a.reach, cast(s.start as long))) as total, greatest(a.reach, cast(s.end as long)) as reach), a -> a.total)"),
        F.lit(0),
    ).cast("long")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window."""
    own = fresh(docs, "own_key")
    dirty = contamination(docs, items).where("spans is not null").select(F.col("key").alias(own)).distinct()
    return docs.withColumn(own, row_key(F.col("doc_id"), F.col("text"))).join(dirty, own, "left_anti").drop(own)


def op4(docs: DataFrame, items: DataFrame) -> DataFrame:
    rows = contamination(docs, items)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", covered("spans").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated")
    )
