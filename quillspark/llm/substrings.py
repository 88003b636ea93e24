"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all texts, in words, would form one tree in which a node of depth
`window` with leaves of several documents is a repeat. The forest is cut by prefix
so that no task holds much of it:

* Sparse suffixes. Of each window's k-word prefixes the one with the least hash
  anchors the window, so equal windows anchor alike, wherever they stand. Suffixes
  are grouped by their anchor's k words. A group of one text has no deep node and
  is dropped here, before its windows are ever written out.
* Variable-length prefixes. A group of up to `GROUP_ROWS` anchors is one subtree,
  named by its k-word prefix. A larger one is split further, by the full window.
* Subtrees. The windows of a group are sorted, which lays its suffixes out in tree
  order: neighbours that share a whole window are leaves of one internal node at
  depth `window`. A leaf whose document is not the node's smallest is a repeat.
  Repeats that follow each other join to a maximal one.

Equal texts are one leaf set with the smallest id; the other copies go as a whole.

Defined results: a null text has no words; a null id counts as larger than all
others; rows with equal ids never remove from each other; a text of fewer words
than the window loses nothing; an empty table gives an empty table; extra columns
do not matter. Windows are told apart by 128 bits: a 64-bit name of the anchor's words and
one of all words, made from the words' 64-bit hashes; the words themselves are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import text_bytes, text_key
from quillspark.llm.decontaminate import chunks, shingle_hashes, word_hashes

WINDOW = 13
PREFIX = 5
GROUP_ROWS = 2_000
LAST_ID = (1 << 63) - 1
EMPTY = sha256(b"").hexdigest()


class Windows:
    """The windows of some texts laid end to end: each text's bounds, and by window its start, its text, its names, and
    its anchor, which is given as the first place in the text that has the anchor's words."""

    def __init__(self, texts: list[bytes], window: int, prefix: int) -> None:
        split = [x.split() for x in texts]
        words = [w for x in split for w in x]
        self.starts = np.cumsum([0, *map(len, split)])
        own, hashes = np.repeat(np.arange(len(split)), np.diff(self.starts)), word_hashes(words)
        prefixes, whole = shingle_hashes(hashes, prefix), shingle_hashes(hashes, window)
        n = len(whole)
        best, shift = prefixes[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - prefix + 1):
            less = prefixes[j : j + n] < best
            best[less], shift[less] = prefixes[j : j + n][less], j
        at = np.flatnonzero(own[:n] == own[window - 1 :]) if n else np.zeros(0, np.int64)
        self.at, self.own = at, own[at]
        self.prefix_name, self.name = best[at].view(np.int64), whole[at].view(np.int64)
        self.anchor = first_alike(self.own, self.prefix_name, at + shift[at])


def first_alike(own: np.ndarray, name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the least place among the rows of its text and name."""
    order = np.lexsort((at, name, own))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(own[order]) != 0) | (np.diff(name[order]) != 0)
    out = np.empty_like(at)
    out[order] = at[order][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return out


def _places(own: np.ndarray, at: np.ndarray, starts: np.ndarray, dup: np.ndarray) -> np.ndarray:
    """A text's number among those of its id, and a word's number in the text, in one long."""
    return (dup[own] << 40) | (at - starts[own])


def anchors(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """name, first, place of the anchors of texts (first, dup, data): one row a text and name."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Windows(batch.column(2).to_pylist(), window, prefix)
            _, new = np.unique(w.anchor, return_index=True)
            own, first, dup = w.own[new], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.prefix_name[new]), pa.array(first[own]), pa.array(_places(own, w.anchor[new], w.starts, dup))],
                ["name", "first", "place"]
            )

    return texts.select("first", "dup", "data").mapInArrow(find, "name long, first long, place long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Columns of whole runs of equal keys (the first columns), with their bounds, from sorted batches.

    A run of more than most rows comes in pieces, each alone and with True.
    """
    held: list[np.ndarray] = []
    large = False
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not len(columns[0]):
            continue
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:keys]], axis=0)) + 1
        if large and len(cuts):  # the end of a run that was too large to hold
            yield [c[: cuts[0]] for c in columns], np.array([0, cuts[0]]), True
            columns, cuts, large = [c[cuts[0] :] for c in columns], cuts[1:] - cuts[0], False
        if len(cuts):
            yield [c[: cuts[-1]] for c in columns], np.concatenate([[0], cuts]), False
            columns = [c[cuts[-1] :] for c in columns]
        if len(columns[0]) > most:
            yield columns, np.array([0, len(columns[0])]), True
            large, columns = True, [c[-1:] for c in columns]
            # one row stays as the run's name; reading it twice does no harm, since rows are a set
        held = columns
    if held and len(held[0]):
        yield held, np.array([0, len(held[0])]), large


def shared_anchors(found: DataFrame) -> DataFrame:
    """first, dup, at of anchors in groups of several texts; at is doubled, odd for groups over GROUP_ROWS."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, first, place), bounds, large in _runs(batches, 1, GROUP_ROWS):
            dup, sizes = place >> 40, np.diff(bounds)
            differ = np.zeros(len(first), bool)
            differ[1:] = (np.diff(first) != 0) | (np.diff(dup) != 0)
            differ[bounds[:-1]] = False
            keep = np.repeat(np.add.reduceat(differ, bounds[:-1]) > 0, sizes) | large
            heavy = np.repeat(sizes > GROUP_ROWS, sizes) | large
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[keep]), pa.array(dup[keep]), pa.array((2 * (place & ((1 << 40) - 1)) + heavy)[keep])],
                ["first", "dup", "at"]
            )

    return found.repartition("name").sortWithinPartitions("name").mapInArrow(share, "first long, dup long, at long")


def suffixes(texts: DataFrame, window: int, prefix: int) -> DataFrame:
    """p, q (the group's prefix and the rest of the name), first, place of the windows at the shared anchors of texts (first, dup,
    anchors, data): one row a text and window, with its first place."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Windows(batch.column(3).to_pylist(), window, prefix)
            lists = batch.column(2)
            marks = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            state = np.zeros(int(w.starts[-1]) + 1, np.int8)
            state[w.starts[owner] + (marks >> 1)] = 1 + (marks & 1)
            keep = np.flatnonzero(state[w.anchor])
            keep = keep[first_alike(w.own[keep], w.name[keep], w.at[keep]) == w.at[keep]]
            heavy, own = state[w.anchor[keep]] == 2, w.own[keep]
            name, whole = w.prefix_name[keep], w.name[keep]
            first, dup = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = np.where(heavy, whole, name), np.where(heavy, name, whole), first[own], _places(own, w.at[keep], w.starts, dup)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["p", "q", "first", "place"])

    return texts.select("first", "dup", "anchors", "data").mapInArrow(spell, "p long, q long, first long, place long")


def repeats(leaves: DataFrame) -> DataFrame:
    """first, dup, at of windows that a smaller document has too: leaves under a deep node that are not of its smallest document."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: tuple = ()
        for batch in batches:
            p, q, first, place = (c.to_numpy() for c in batch.columns)
            if not len(p):
                continue
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(p) != 0) | (np.diff(q) != 0)
            least = first[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))].copy()
            if node[:2] == (p[0], q[0]):  # the node goes on from the batch before
                least[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(p)] = node[2]
            node = p[-1], q[-1], least[-1]
            late = first > least
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[late]), pa.array(place[late] >> 40), pa.array(place[late] & ((1 << 40) - 1))], ["first", "dup", "at"]
            )

    return leaves.repartition("p").sortWithinPartitions("p", "q", "first").mapInArrow(climb, "first long, dup long, at long")


def spans_of(at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal repeats: the union of windows that start at the sorted places."""
    cuts = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(at, cuts)] if len(at) else []


def all_spans(words: list[bytes], starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal repeats of a text, from the first places of its repeated windows."""
    names = shingle_hashes(word_hashes(words), window)
    return spans_of(np.flatnonzero(np.isin(names, names[starts])), window)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """Two tables. Of distinct texts: key, first (the smallest id), data, starts (first places of repeated windows; null if none).
    Of documents: doc_id, id (with nulls as LAST_ID), key."""
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    rows = docs.select(F.col(doc_id).alias("doc_id"), order.alias("id"), text_key(F.col(text)).alias("key"))
    ids = rows.groupBy("key").agg(F.min("id").alias("first"))
    ids = ids.withColumn("dup", F.row_number().over(Window.partitionBy("first").orderBy("key")).cast("long") - 1)
    data = docs.select(text_key(F.col(text)).alias("key"), text_bytes(F.col(text)).alias("data")).groupBy("key").agg(F.first("data").alias("data"))
    texts = data.join(ids, "key")

    def by_text(places: DataFrame, column: str) -> DataFrame:
        lists = places.groupBy("first", "dup").agg(F.collect_list("at").alias(column))
        return lists.join(ids, ["first", "dup"]).select("key", column)

    shared = by_text(shared_anchors(anchors(texts, window, prefix)), "anchors")
    found = by_text(repeats(suffixes(texts.join(shared, "key"), window, prefix)), "starts")
    return texts.join(found, "key", "left").select("key", "first", "data", "starts"), rows


def op8(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    texts, rows = repeated_spans(docs, window=window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, counts = [], [], []
            for data, starts in zip(batch.column(2), batch.column(3), strict=True):
                words, cut_words = data.as_py().split(), 0
                counts.append(len(words))
                for a, b in reversed(all_spans(words, starts.values.to_numpy(), window) if starts.is_valid else []):
                    del words[a:b]
                    cut_words += b - a
                removed.append(cut_words)
                digests.append(sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["key", "first", "n_words", "removed", "digest"]
            )

    done = texts.mapInArrow(keep, "key binary, first long, n_words long, removed long, digest string")
    copy: Column = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    return rows.join(done, "key").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("removed")).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.col("digest")).alias("kept_sha256")
    )
