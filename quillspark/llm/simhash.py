"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of 2 bits; its vector of segment
bit counts lies in {0,1,2}^32, and the Manhattan distance of two vectors is at
most the fingerprints' Hamming distance. The grid range-join finds all vectors
within Manhattan distance 2: both sides visit the grid cells at distance 0 or 1
of their own, since two such vectors always have a common cell there. What
meets in a cell is verified by exact Hamming distance: in cells of at most
`PAIR_CELL` fingerprints pair by pair; in fuller cells by the exact points at
Hamming distance 0 or 1 (at most 65 fingerprints can share one, and all that do
are linked), so a crowded cell costs in proportion to its rows and loses no link.

Equal fingerprints are one node; links join nodes, never documents.

Defined results: a null or blank text has fingerprint zero and links like any
other; a null id never names a component unless all ids in it are null;
repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import cut, fresh, join_counted, row_key, text_bytes
from quillspark.llm.graph import components
from quillspark.llm.overlap import set_links

PAIR_CELL = 32
#: Fingerprints that one task spreads over their cells.
TASK_PRINTS = 20_000
#: Names of rows (17 bytes each) that are broadcast; above, the texts are shuffled.
BROADCAST_ROWS = 500_000
LOW_BITS = 0x5555555555555555
CHUNK = 1 << 16


def simhash(data: bytes, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of the lower-cased words' shingles; repeats count."""
    words = data.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    text = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)], starts[at + size :], strict=False)
        hashes = np.array([xxh64_intdigest(text[a : b - 1], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(x.as_py(), shingle) for x in texts], pa.int64())

    return prints(text_bytes(text))


def grid_cells(fp: Column) -> Column:
    """The cells at Manhattan distance 0 or 1 of the fingerprint's vector, two bits a segment."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(fp).bitwiseAND(F.lit(LOW_BITS))
    odd = F.shiftrightunsigned(fp, 1).bitwiseXOR(fp).bitwiseAND(F.lit(LOW_BITS))
    own = F.shiftleft(high, 1).bitwiseOR(odd)
    near = [own]
    for i in range(0, 64, 2):
        one, three = (x - (1 << 64) if x >= 1 << 63 else x for x in (1 << i, 3 << i))
        count = F.shiftrightunsigned(own, i).bitwiseAND(F.lit(3).cast("long"))
        near.append(F.when(count < 2, own.bitwiseXOR(F.lit(one).cast("long"))))
        near.append(F.when(count > 0, own.bitwiseXOR(F.lit(three).cast("long"))))
    return F.array_compact(F.array(*near))


def hamming_points(fp: Column) -> Column:
    bits = [x - (1 << 64) if x >= 1 << 63 else x for x in (1 << i for i in range(64))]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(x).cast("long")) for x in bits))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints (column fp) that spans the same components as all pairs within 2 bits."""
    n = prints.count()
    # each fingerprint becomes some 45 rows: few a task, however few tasks the fingerprints came from
    own = prints.select("fp").repartition(max(prints.sparkSession.sparkContext.defaultParallelism, n // TASK_PRINTS + 1))
    placed = own.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell"))
    shared = cut(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(join_counted(placed, shared.withColumn("members", F.col("n")), ["cell"]))
    within = "transform(filter(fps, y -> y > x and bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))"
    pairs = (
        met.where(F.col("n") <= PAIR_CELL).groupBy("cell").agg(F.collect_list("fp").alias("fps"))
        .select(F.explode(F.expr(f"flatten(transform(fps, x -> {within}))")).alias("p")).select("p.a", "p.b")
    )
    crowded = met.where(F.col("n") > PAIR_CELL).select("fp").distinct().select("fp", F.explode(hamming_points(F.col("fp"))).alias("point"))
    stars = (
        crowded.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b")).where("a != b")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row a document: doc_id, row (its row_key), fp, component_id."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row"), fingerprint(F.col(text), shingle).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")))
    roots = components(fingerprint_links(prints))
    nodes = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "members", F.coalesce("root", "fp").alias("root"))
    named = cut(nodes.join(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "members", "component_id"))
    return join_counted(rows, named, ["fp"])


def similar_groups(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates whose components are also joined by texts that share percent of their five-word shingles (Jaccard)."""
    found = cut(near_duplicates(docs))
    sets, links = set_links(docs, percent)
    node = sets.groupBy("row").agg(F.first("node").alias("node"))
    rows = cut(found.join(node, "row"))
    # texts of one 2-bit component are linked to its smallest node; a null component_id names its fingerprint's own
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    same = rows.groupBy(group.alias("g")).agg(F.min("node").alias("first"))
    near = rows.select(group.alias("g"), F.col("node").alias("b")).distinct()
    near = near.join(same, near["g"].eqNullSafe(same["g"])).select(F.col("first").alias("a"), "b")
    roots = components(links.unionByName(near))
    nodes = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return nodes.drop("component_id").join(named, "root").select("doc_id", "row", F.hex("root").alias("fp"), "component_id")


def keep_one(docs: DataFrame, percent: int | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the row of its smallest doc_id stays (of ties, the smallest row key).

    With percent, texts of that Jaccard similarity over five words are near-duplicates too.
    """
    found = near_duplicates(docs) if percent is None else similar_groups(docs, percent)
    first = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    stay = found.groupBy(group.alias("g")).agg(F.min(first).alias("row")).select("row")
    # what happens to a row that neither stays alone nor is plain: False, it goes; True, it is one of several that agree in all
    counts = found.groupBy("row").agg((F.count("*") > 1).alias("again"))
    told = counts.join(
        stay.withColumn("stays", F.lit(True)), "row", "left"
    ).where("stays is null or again").select("row", (F.col("stays").isNotNull()).alias("stays"))
    own, stays = fresh(docs, "stay_row"), fresh(docs, "stay_told")
    told = cut(told.select(F.col("row").alias(own), F.col("stays").alias(stays)))
    rows = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text")))
    rows = rows.join(F.broadcast(told) if told.count() <= BROADCAST_ROWS else told, own, "left")
    return rows.where(F.col(stays).isNull()).unionByName(rows.where(F.col(stays)).dropDuplicates([own])).drop(own, stays)


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
