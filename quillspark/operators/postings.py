"""A stored inverted index: for each word the documents that hold it, with their places, in partitions by the word's hash.

A search reads the partitions of the words it asks for and no text. Each task of the build writes a file a partition, so the rows of a
common word are spread over many files. Within a block they are in the order of words, so that the file format's own statistics skip some.

A row holds what a block of some thousand documents has of a word, as arrays side by side. Blocks are formed and put in order by Arrow
inside tasks, so the build neither shuffles nor sorts (a shuffle of the blocks is three times as large as the texts' files);
searches spread out the blocks of their words.

Changes are appended as versions: the documents of a version replace their earlier selves, and a removed document leaves an
empty one. Number of documents and of words are kept beside, as one row a version; that row is written last, so a
version that was not finished does not count, and writing it again overwrites it. One writer at a time. `compact` makes one version of all.

Layout: rows/version=V/bucket=B (word, keys, dls, ends, places; ends: of each key's places in the row's); bucket -1 has all documents,
with dl null for a removed one. sums/version=V (documents, words, buckets, kind: the keys' type).

Defined results: keys are unique among the documents given; a null text has no words and counts as a document; no
documents make an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Partitions of words, and files of each after `compact`; an index of N documents is given about N / 100,000 partitions, these at least.
BUCKETS, FILES = 16, 4
#: Files that a task of the build has open; with more partitions than that, the rest of its rows is sorted.
OPEN_FILES = 256
#: Words (some 40 bytes each) up to which their table is broadcast; up to FEW_WORDS they go into the filter of the scan.
BROADCAST_WORDS, FEW_WORDS = 200_000, 2_000
#: Prefixes up to which the scan itself looks for them (and skips what is between).
FEW_PREFIXES = 100
#: Changed documents (some 30 bytes each) up to which their list is broadcast.
BROADCAST_KEYS = 500_000
#: Documents and words (places) of one block of rows; a longer document is a block of its own.
BLOCK_DOCUMENTS, BLOCK_WORDS = 4_096, 2_000_000
K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def weight(f: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))


def entries(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """key, dl, word, places (from 0, ascending) of rows with key, toks, dl; only: of these words.

    A row's words are sorted with their places and cut into runs, so a long text takes no more than sorting it.
    """
    pairs = F.transform("toks", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    pairs = pairs if only is None else F.filter(pairs, lambda x: x["w"].isin(only))
    at = rows.select("key", "dl", F.sort_array(pairs).alias("pairs")).where(F.size("pairs") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: (i == 0) | (F.get("pairs", i)["w"] != F.get("pairs", i - 1)["w"]))
    runs = at.select("key", "dl", "pairs", starts.alias("starts"))
    run = lambda s, j: F.struct(
        F.get("pairs", s)["w"].alias("word"),
        F.transform(F.slice("pairs", s + 1, F.coalesce(F.get("starts", j + 1), F.size("pairs")) - s), lambda x: x["i"]).alias("places"),
    )
    return runs.select("key", "dl", F.explode(F.transform("starts", run)).alias("r")).select("key", "dl", "r.word", "r.places")


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """word, keys, dls, ends, places of rows with key, toks: a row for each word that they have, in order, after one for all rows (word "", no places)."""
    sizes, n = rows["toks"].value_lengths().to_numpy(zero_copy_only=False).astype("i8"), len(rows)
    words = rows["toks"].flatten().dictionary_encode()
    in_order = pc.sort_indices(words.dictionary)
    codes = np.argsort(in_order.to_numpy())[words.indices.to_numpy(zero_copy_only=False)]
    order = np.argsort(codes, kind="stable")  # within a word documents and places stay in order
    code, document = codes[order], np.repeat(np.arange(n), sizes)[order]
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].astype("i4")
    new_word = np.r_[True, code[1:] != code[:-1]] if len(code) else np.empty(0, bool)
    held = np.flatnonzero(new_word | np.r_[True, document[1:] != document[:-1]]) if len(code) else np.empty(0, "i8")
    first = np.flatnonzero(new_word[held])  # of each word its first document
    ends = np.r_[held[1:], len(code)] - np.repeat(held[first], np.diff(np.r_[first, len(held)]))
    by_word, at = pa.array(np.r_[0, n + first, n + len(held)].astype("i4")), np.r_[np.arange(n), document[held]]
    lists = lambda values: pa.ListArray.from_arrays(by_word, values)
    columns = [
        pa.concat_arrays([pa.array([""], words.dictionary.type), words.dictionary.take(in_order)]),
        lists(rows["key"].take(pa.array(at))), lists(pa.array(sizes[at].astype("i4"))), lists(pa.array(np.r_[np.zeros(n, "i4"), ends].astype("i4"))),
        pa.ListArray.from_arrays(pa.array(np.r_[0, held[first], len(code)].astype("i4")), pa.array(place)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["word", "keys", "dls", "ends", "places"])


def _blocks(rows: DataFrame) -> DataFrame:
    """word, keys, dls, ends, places of rows with key, toks, by blocks of documents; word "" has the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, start = np.cumsum(batch["toks"].value_lengths().to_numpy(zero_copy_only=False).astype("i8")), 0
            while start < len(batch):
                before = upto[start - 1] if start else 0
                end = min(start + BLOCK_DOCUMENTS, max(start + 1, int(np.searchsorted(upto, before + BLOCK_WORDS, side="right"))))
                yield _block(batch.slice(start, end - start))
                start = end

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "toks").mapInArrow(run, f"word string, keys array<{kind}>, dls array<int>, ends array<int>, places array<int>")


def _spread(blocks: DataFrame) -> DataFrame:
    """The rows of blocks: key, dl, f, places in place of keys, dls, ends, places."""
    kept = [c for c in blocks.columns if c not in ("keys", "dls", "ends", "places")]
    each = blocks.select(*kept, "dls", "ends", "places", F.posexplode("keys").alias("at", "key"))
    start = F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))
    f = F.get("ends", F.col("at")) - start
    return each.select(*kept, "key", F.get("dls", F.col("at")).alias("dl"), f.alias("f"), F.slice("places", start + 1, f).alias("places"))


def _starting(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows, each once for each of the prefixes (column prefix, distinct) that its word starts with; no row is moved for few prefixes."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]  # of words that someone typed
    known = [r["prefix"] for r in prefixes.limit(FEW_WORDS + 1).collect()]
    cuts = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(F.length("word") >= n, F.left("word", n)))
    if len(known) > FEW_WORDS:
        return rows.select("*", F.explode(F.array_compact(cuts)).alias("prefix")).join(F.broadcast(prefixes) if prefixes.count() <= BROADCAST_WORDS else prefixes, "prefix")
    if len(known) <= FEW_PREFIXES:
        rows = rows.where(reduce(or_, (F.col("word").startswith(p) for p in known), F.lit(False)))
    return rows.select("*", F.explode(F.filter(cuts, lambda c: c.isin(known))).alias("prefix"))


def _alone(rows: DataFrame) -> DataFrame:
    """Each row (bucket, word, key, dl, places) as a block of its own."""
    ends, dl = F.array(F.size("places")), F.col("dl").cast("int")
    return rows.select("bucket", "word", F.array("key").alias("keys"), F.array(dl).alias("dls"), ends.alias("ends"), "places")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


@contextmanager
def _open_files(spark: SparkSession) -> Iterator[None]:
    """Writes by partitions keep several files open, where Spark would else sort each task's rows by partition."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Index:
    """What a search needs: the rows of words and of prefixes, and the documents' number and mean length."""

    def stats(self) -> DataFrame:
        """One row: n, avgdl."""
        raise NotImplementedError

    def rows_of(self, words: DataFrame) -> DataFrame:
        """key, dl, word, f, places of the given words (column word, distinct); f: how many places."""
        raise NotImplementedError

    def rows_starting(self, prefixes: DataFrame) -> DataFrame:
        """key, dl, prefix, f, places of the words that start with each of the prefixes (column prefix, distinct); a row a word."""
        raise NotImplementedError


class Unstored(Index):
    """An index over tokenised rows (key, toks, dl), made anew by each search, of the words it asks for."""

    def __init__(self, corpus: DataFrame, key: str) -> None:
        self.corpus = corpus.select(F.col(key).alias("key"), "toks", "dl")

    def stats(self) -> DataFrame:
        return self.corpus.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def rows_of(self, words: DataFrame) -> DataFrame:
        known = [r["word"] for r in words.limit(FEW_WORDS + 1).collect()]
        if len(known) <= FEW_WORDS:
            rows = entries(self.corpus, known)
        else:
            rows = entries(self.corpus).join(F.broadcast(words) if words.count() <= BROADCAST_WORDS else words, "word", "left_semi")
        return rows.select("key", "dl", "word", F.size("places").alias("f"), "places")

    def rows_starting(self, prefixes: DataFrame) -> DataFrame:
        return _starting(entries(self.corpus), prefixes).select("key", "dl", "prefix", F.size("places").alias("f"), "places")


@dataclass(frozen=True)
class Stored(Index):
    """An index in a folder that all executors share."""

    spark: SparkSession
    path: str

    def _sums(self) -> DataFrame:
        return self.spark.read.schema("documents long, words long, buckets int, kind string, version int").parquet(f"{self.path}/sums")

    def versions(self) -> list[int]:
        return sorted(r["version"] for r in self._sums().select("version").collect())

    def layout(self) -> tuple[int, str]:
        """Number of buckets and the keys' type."""
        return tuple(self._sums().where("version = 0").select("buckets", "kind").first())

    def stats(self) -> DataFrame:
        n = F.sum("documents")
        return self._sums().agg(n.alias("n"), F.when(n > 0, F.sum("words") / n).alias("avgdl"))

    def _all(self, versions: list[int], kind: str | None = None) -> DataFrame:
        kind = kind or self.layout()[1]
        columns = f"word string, keys array<{kind}>, dls array<int>, ends array<int>, places array<int>, version int, bucket int"
        rows = self.spark.read.schema(columns).parquet(f"{self.path}/rows")
        return rows.where(F.col("version").isin(versions))

    def _live(self, rows: DataFrame, versions: list[int]) -> DataFrame:
        """Of rows those that no later version replaced."""
        if versions == [0]:
            return rows
        changed = _spread(self._all(versions).where("bucket = -1 and version > 0")).groupBy("key").agg(F.max("version").alias("newest"))
        changed = F.broadcast(changed) if changed.count() <= BROADCAST_KEYS else changed
        return rows.join(changed, "key", "left").where("version = coalesce(newest, 0)").drop("newest")

    def documents(self) -> DataFrame:
        """key, dl of the documents that are there."""
        versions = self.versions()
        return self._live(_spread(self._all(versions).where("bucket = -1")), versions).where("dl is not null").select("key", "dl")

    def rows_of(self, words: DataFrame) -> DataFrame:
        versions, (buckets, kind) = self.versions(), self.layout()
        asked = words.select("word", _bucket(F.col("word"), buckets).alias("bucket"))
        known = asked.limit(FEW_WORDS + 1).collect()
        rows = self._all(versions, kind)
        if len(known) <= FEW_WORDS:
            rows = rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in known})) & F.col("word").isin([r["word"] for r in known]))
        else:
            rows = rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_WORDS else asked, ["bucket", "word"], "left_semi")
        return self._live(_spread(rows), versions).select("key", "dl", "word", "f", "places")

    def rows_starting(self, prefixes: DataFrame) -> DataFrame:
        versions = self.versions()
        rows = _starting(self._all(versions).where("bucket >= 0"), prefixes)
        return self._live(_spread(rows), versions).select("key", "dl", "prefix", "f", "places")

    def document_frequencies(self) -> DataFrame:
        """word, df over the documents that are there."""
        versions = self.versions()
        rows = self._all(versions).where("bucket >= 0")
        if versions == [0]:
            return rows.groupBy("word").agg(F.sum(F.size("keys")).alias("df"))
        return self._live(_spread(rows), versions).groupBy("word").agg(F.count("*").alias("df"))

    def _write(self, version: int, rows: DataFrame, gone: DataFrame | None, buckets: int) -> tuple[int, int]:
        """Documents and words of a version. rows: key, toks, dl of new documents; gone: keys (column key) of removed ones."""
        none, kind, bucket = F.array().cast("array<int>"), rows.schema["key"].dataType.simpleString(), _bucket(F.col("word"), buckets)
        blocks = _blocks(rows).select(F.when(F.col("word") == "", F.lit(-1)).otherwise(bucket).alias("bucket"), "*")
        if gone is not None:
            blocks = blocks.unionByName(_alone(gone.select(F.lit(-1).alias("bucket"), F.lit("").alias("word"), "key", F.lit(None).alias("dl"), none.alias("places"))))
        return self._put(version, blocks, kind)

    def _put(self, version: int, blocks: DataFrame, kind: str) -> tuple[int, int]:
        with _open_files(self.spark):
            blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        return self._sizes(_spread(self._all([version], kind).where("bucket = -1")).where("dl is not null"))

    def _commit(self, version: int, documents: int, words: int, buckets: int, kind: str) -> None:
        rows = self.spark.range(1).select(
            F.lit(documents).cast("long").alias("documents"), F.lit(words).cast("long").alias("words"), F.lit(buckets).alias("buckets"), F.lit(kind).alias("kind")
        )
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/version={version}")

    def _sizes(self, documents: DataFrame) -> tuple[int, int]:
        return tuple(documents.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def replace(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """docs as the next version: new ones, and new selves of those that are there."""
        self._change(tokenised(docs, key, text), None)

    def remove(self, keys: DataFrame) -> None:
        """keys (one column): documents to take out; keys that aren't there change nothing."""
        there = keys.toDF("key").distinct().join(self.documents().select("key"), "key", "left_semi")
        self._change(None, there)

    def _change(self, rows: DataFrame | None, gone: DataFrame | None) -> None:
        before, version, (buckets, kind) = self.documents(), max(self.versions()) + 1, self.layout()
        keys = (rows if gone is None else gone).select("key").distinct()
        old = self._sizes(before.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi"))
        none = before.select("key", F.array().cast("array<string>").alias("toks"), "dl").where("false")
        new = self._write(version, none if rows is None else rows.withColumn("key", F.col("key").cast(kind)), gone, buckets)
        self._commit(version, new[0] - old[0], new[1] - old[1], buckets, kind)

    def compact(self, path: str) -> Stored:
        """The same index in another folder, as one version."""
        versions, (buckets, kind), other = self.versions(), self.layout(), Stored(self.spark, path)
        rows = self._live(_spread(self._all(versions, kind)), versions).where("bucket >= 0 or dl is not null")
        pieces = rows.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(FILES))).repartition("bucket", "piece").sortWithinPartitions("bucket", "word", "key")
        other._commit(0, *other._put(0, _alone(pieces), kind), buckets, kind)
        return other


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    toks = F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>"))
    return docs.select(F.col(key).alias("key"), toks.alias("toks"), F.coalesce(T.n_tokens(F.col(text)), F.lit(0)).alias("dl"))


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> Stored:
    """An index of docs in an empty folder."""
    index, rows = Stored(docs.sparkSession, path), tokenised(docs, key, text)
    buckets = max(BUCKETS, min(4096, docs.count() // 100_000)) if buckets is None else buckets
    index._commit(0, *index._write(0, rows, None, buckets), buckets, rows.schema["key"].dataType.simpleString())
    return index


# phrases


def held(index: Index, phrases: DataFrame) -> DataFrame:
    """query_id, phrase_no, key, dl, f, starts: where the words of each phrase follow each other.

    phrases: query_id, phrase_no, words (array of strings), and where they may be given: open (array of booleans: the word stands for
    all words that start with it), first (boolean: the phrase must start the text).
    """
    for name, none in (("open", F.array().cast("array<boolean>")), ("first", F.lit(False))):
        phrases = phrases if name in phrases.columns else phrases.withColumn(name, none)
    phrases = phrases.where(F.size("words") > 0)
    spots = phrases.select("query_id", "phrase_no", F.size("words").alias("m"), "first", "open", F.posexplode("words").alias("i", "word"))
    spots = spots.withColumn("open", F.coalesce(F.get("open", F.col("i")), F.lit(False))).withColumn("run", F.expr("m > 1 or first"))
    counts = {(r["run"], r["open"]): r["count"] for r in spots.groupBy("run", "open").count().collect()}

    def rows_of(run: bool, open: bool) -> DataFrame:
        on, n = "prefix" if open else "word", counts.get((run, open), 0)
        own = spots.where((F.col("run") == run) & (F.col("open") == open)).drop("run", "open").withColumnRenamed("word", on)
        rows = (index.rows_starting if open else index.rows_of)(own.select(on).distinct())
        return rows.join(F.broadcast(own) if n <= BROADCAST_WORDS else own, on).drop(on)

    def rows(run: bool) -> DataFrame:
        exact = rows_of(run, False)
        return exact.unionByName(rows_of(run, True)) if (run, True) in counts else exact

    hits = rows(False).select("query_id", "phrase_no", "key", "dl", "f", F.col("places").alias("starts"))
    if any(run for run, _ in counts):
        at = F.when(~F.col("first"), F.transform("places", lambda p: p - F.col("i"))).when(F.array_contains("places", F.col("i")), F.array(F.lit(0)))
        runs = rows(True).select("query_id", "phrase_no", "key", "dl", "m", "i", at.alias("at")).where("at is not null").repartition("key")
        runs = runs.groupBy("query_id", "phrase_no", "key", "dl", "m").agg(F.collect_list(F.struct("i", "at")).alias("parts"))
        runs = runs.where(F.size(F.array_distinct(F.transform("parts", lambda p: p["i"]))) == F.col("m"))
        of = lambda i: F.flatten(F.transform(F.filter("parts", lambda p: p["i"] == i), lambda p: p["at"]))
        both = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("m") - 1, F.lit(1))), of(F.lit(0)), lambda s, i: F.when(F.col("m") == 1, s).otherwise(F.array_intersect(s, of(i))))
        runs = runs.select("query_id", "phrase_no", "key", "dl", both.alias("starts"))
        hits = hits.unionByName(runs.select("query_id", "phrase_no", "key", "dl", F.size("starts").alias("f"), "starts").where("f > 0"))
    if (False, True) in counts:  # a word and its longer ones; a document's rows meet once, for this and for what callers do with documents
        hits = hits.repartition("key").groupBy("query_id", "phrase_no", "key", "dl")
        hits = hits.agg(F.sum("f").cast("int").alias("f"), F.flatten(F.collect_list("starts")).alias("starts"))
    return hits
