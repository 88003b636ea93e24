"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a bound: they span what all such pairs span.

A prefix-filtered set join: shingles have one order over all texts, and two sets of similarity s or more share a shingle among
the first n - ceil(s * n) + 1 of each. The order puts shingles last that are common: in a sample, and then, counted over all
texts, those that still bring many texts together. It is one order for all texts, hence no pair is lost whatever is found common.

Equal texts are one node, named by 128 bits. First each node is verified with one partner, of the smallest nodes of its
groups the one that it meets most often, and linked nodes become components. What is left are nodes that meet in a group
and lie in different components. They are not paired: nodes are put in bundles of about BUNDLE, by component or by the
partner that they met most often, and by size, and bundles meet. Their members' sketches say which of them may be similar to
any of the others'; the sets of those travel once for the two bundles, and all their shared counts come out of one
product of 0/1 matrices, of which only links between different components are kept. So a group of n nodes makes
(n / BUNDLE) squared rows, no set travels with a pair, and nothing is capped or dropped.

Defined results: a null or blank text has no shingles and no links; texts that differ only in the case of A to Z or in white
space have equal sets; repeated rows share their node; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import cut, join_counted, row_key, stored, text_bytes, text_key
from quillspark.llm.graph import components

#: Texts in the sample of shingles, least count there and number of those that come last: they bear on the speed only.
SAMPLE, COMMON, MOST_COMMON = 10_000, 8, 20_000
#: Counts in a set's sketch; more tell more of longer texts apart. It bears on the speed only.
COUNTS = 256
#: Texts that meet by a shingle from which on it counts as common, too.
CROWD = 64
#: Classes of shingles that are counted together to find those (8 bytes each in a task).
CLASSES = 1 << 17
#: Names of texts to verify (32 bytes each) that are broadcast; above, the texts are shuffled.
BROADCAST_NODES = 1_000_000
#: Nodes of a bundle, and shingles of all of them, about; shingles of two bundles that are multiplied at once.
BUNDLE, BUNDLE_ITEMS, COLUMNS = 128, 1 << 20, 1 << 15


def shingles(data: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the lower-cased words' shingles; a shorter text is one shingle."""
    words = data.lower().split()
    if not words:
        return np.empty(0, "<u8")
    size = min(shingle, len(words))
    text = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.array([xxh64_intdigest(text[a : b - 1], 7) for a, b in zip(starts, starts[size:], strict=False)], "<u8"))


def least_shared(percent: int, n: int) -> int:
    return -(-percent * n // 100)


def sets(text: Column, percent: int, shingle: int, last: np.ndarray | None = None) -> Column:
    """size, and the prefix's shingles in order."""
    common = np.empty(0, "<u8") if last is None else last

    @F.arrow_udf("struct<size:int,prefix:array<bigint>>")
    def find(texts: pa.Array) -> pa.Array:
        sizes, firsts = [], []
        for x in texts:
            own = shingles(x.as_py(), shingle)
            sizes.append(len(own))
            late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
            rest = np.concatenate([own[~late], own[late]])
            firsts.append(rest[: len(own) - least_shared(percent, len(own)) + 1 if len(own) else 0].view("<i8"))
        ends = np.cumsum([0, *map(len, firsts)]).astype("i4")
        prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*firsts, np.empty(0, "<i8")])))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), prefix], ["size", "prefix"])

    return find(text_bytes(text))


def whole_set(text: Column, shingle: int) -> Column:
    @F.arrow_udf("binary")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), shingle).tobytes() for x in texts], pa.binary())

    return find(text_bytes(text))


def sketch(text: Column, shingle: int) -> Column:
    """How many shingles fall to each of COUNTS classes, a byte each; 255 stands for more, too."""

    @F.arrow_udf("binary")
    def find(texts: pa.Array) -> pa.Array:
        counts = (np.bincount(shingles(x.as_py(), shingle) % np.uint64(COUNTS), minlength=COUNTS) for x in texts)
        return pa.array([np.minimum(c, 255).astype("u1").tobytes() for c in counts], pa.binary())

    return find(text_bytes(text))


def most_shared(a: Column, b: Column) -> Column:
    """How many shingles two sets can share by their sketches; null if they don't tell."""

    @F.arrow_udf("int")
    def bound(left: pa.Array, right: pa.Array) -> pa.Array:
        rows = ((np.frombuffer(x.as_py(), "u1"), np.frombuffer(y.as_py(), "u1")) for x, y in zip(left, right, strict=True))
        least = (np.minimum(x, y) for x, y in rows)
        return pa.array([None if (m == 255).any() else int(m.sum(dtype=np.int64)) for m in least], pa.int32())

    return bound(a, b)


def similar(a: Column, b: Column, percent: int) -> Column:
    @F.arrow_udf("boolean")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return compare(a, b)


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Shingles that many texts of a sample share, sorted."""
    rows = docs.select(F.col(text).alias("text"))
    sample = rows.sample(min(1.0, SAMPLE / max(1, rows.count())), 1)
    every = sample.select(F.explode(sets(F.col("text"), 0, shingle)["prefix"]).alias("token"))
    top = every.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    return np.sort(top.select("token").toArrow()["token"].to_numpy().view("<u8"))


def crowded(nodes: DataFrame) -> np.ndarray:
    """The shingles that bring most texts together (at least CROWD) in the prefixes of nodes, sorted.

    All are counted: first by classes of shingles, a fixed number of counters a task, and then, in the classes that stand out,
    shingle by shingle.
    """
    prefixes = nodes.select("prefix")

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).view("<u8")

    def classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for found in tokens(batches):
            counts += np.bincount((found >> np.uint64(40)) % np.uint64(CLASSES), minlength=CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["class", "n"])

    sums = cut(prefixes.mapInArrow(classes, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")))
    mean = (sums.agg(F.sum("n")).first()[0] or 0) / CLASSES
    full = sums.where(F.col("n") >= CROWD + mean + 4 * mean**0.5).orderBy(F.desc("n"), "class").limit(CLASSES // 8).select("class").toArrow()
    if not full.num_rows:
        return np.empty(0, "<u8")
    wanted = np.zeros(CLASSES, bool)
    wanted[full["class"].to_numpy()] = True

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in tokens(batches):
            own, n = np.unique(found[wanted[(found >> np.uint64(40)) % np.uint64(CLASSES)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view("<i8")), pa.array(n)], ["token", "n"])

    counts = prefixes.mapInArrow(chosen, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWD)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()
    return np.sort(top["token"].to_numpy().view("<u8"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each set of the left shares with each of the right."""
    every = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(every), COLUMNS):
        part = every[at : at + COLUMNS]

        def matrix(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            ones = np.zeros((len(sets), len(part)), "f4")
            for row, items in zip(ones, sets, strict=True):
                low, high = np.searchsorted(items, part[0]), np.searchsorted(items, part[-1], "right")
                row[np.searchsorted(part, items[low:high])] = 1
            return ones

        out += (matrix(left) @ matrix(right).T).astype(np.int64)
    return out


def spanning(nodes: list[int], roots: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs (two columns of places in nodes) those that link components which the ones before leave apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))
    return out


def near_members(members: pa.Table, percent: int) -> pa.Table:
    """Of a pair of bundles the members that may be similar to one of another component, by their sketches. members: as for bundle_links, with size and counts."""
    side, sizes, roots = (members[c].to_numpy() for c in ("side", "size", "root"))
    counts = np.stack([np.frombuffer(x.as_py(), "u1") for x in members["counts"]])
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = two if len(two) else one
    stays = np.zeros(len(side), bool)
    for i in one:
        least = np.minimum(counts[i], counts[two])
        most = least.sum(axis=1, dtype=np.int64)
        may = ((100 + percent) * most >= percent * (sizes[i] + sizes[two]).astype(np.int64)) | (least == 255).any(axis=1)
        may &= (roots[two] != roots[i]) & (100 * np.minimum(sizes[i], sizes[two]) >= percent * np.maximum(sizes[i], sizes[two]))
        stays[two[may]] = True
        stays[i] |= may.any()
    return members.filter(pa.array(stays)).select(["one", "two", "side", "node", "root"])


def bundle_links(members: pa.Table, percent: int) -> pa.Table:
    """(a, b) of one pair of bundles. members: side (0 or 1; a bundle that meets itself has 0 only), node, root, items."""
    side = members["side"].to_numpy()
    nodes, roots = members["node"].to_pylist(), members["root"].to_pylist()  # numbers
    sets = [np.frombuffer(x.as_py(), "<u8") for x in members["items"]]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    two = two if len(two) else one
    both = shared_counts([sets[i] for i in one], [sets[i] for i in two])
    sizes = np.array([len(x) for x in sets])
    near = 100 * both >= percent * (sizes[one][:, None] + sizes[two][None, :] - both)
    i, j = np.nonzero(near)
    links = spanning(nodes, roots, np.column_stack([one[i], two[j]]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def meetings(nodes: DataFrame) -> DataFrame:
    """token, node, size, at, first (the smallest node of the token, with size and at) where a token of the prefixes has several nodes.

    Tokens that many nodes of a sample have are counted where they are, and their rows are not gathered; the others are few to a token.
    """
    placed = nodes.select("node", "size", F.posexplode("prefix").alias("at", "token"))
    sample = nodes.sample(min(1.0, SAMPLE / max(1, nodes.count())), 1).select(F.explode("prefix").alias("token"))
    many = cut(sample.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON).select("token"))
    one, group = F.struct("node", "size", "at"), Window.partitionBy("token")
    few = placed.join(F.broadcast(many), "token", "left_anti").select("*", F.count("*").over(group).alias("n"), F.min(one).over(group).alias("first"))
    crowds = placed.join(F.broadcast(many), "token", "left_semi")
    counted = crowds.groupBy("token").agg(F.count("*").alias("n"), F.min(one).alias("first"))  # at most MOST_COMMON
    return few.unionByName(crowds.join(F.broadcast(counted), "token")).where("n > 1").drop("n")


def set_links(docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row, node) of all rows, and links (a, b) of nodes that span the components of all similar pairs. A node is a text's number."""
    named = cut(docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), text_key(F.col(text)).alias("key")))
    last = common_shingles(docs, text, shingle)
    found = docs.select(text_key(F.col(text)).alias("key"), sets(F.col(text), percent, shingle, last).alias("s")).select("key", "s.size", "s.prefix")
    nodes = stored(found.dropDuplicates(["key"]).withColumn("node", F.monotonically_increasing_id()))
    counts = cut(named.groupBy("key").agg(F.count("*").alias("members")).join(nodes.select("key", "node"), "key"))
    rows = cut(join_counted(named, counts, ["key"]).select("row", "node"))

    def texts_of(names: DataFrame, of: Callable[[Column], Column], column: str) -> DataFrame:
        """node and what of makes of its text, for each of the names."""
        chosen = cut(rows.groupBy("node").agg(F.min("row").alias("row")).join(names.distinct(), "node"))
        few = chosen.count() <= BROADCAST_NODES
        own = docs.select(row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
        return own.join(F.broadcast(chosen) if few else chosen, "row").select("node", of(F.col("text")).alias(column)).dropDuplicates(["node"])

    crowd = crowded(nodes)
    if len(crowd):
        # a text's prefix changes only where it holds a shingle that now comes last
        late = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"token": crowd.view("<i8")})))
        every = np.union1d(last, crowd)
        changed = cut(nodes.select("node", F.explode("prefix").alias("token")).join(late, "token", "left_semi").select("node").distinct())
        again = texts_of(changed, lambda t: sets(t, percent, shingle, every), "s").select("node", "s.size", "s.prefix")
        kept = nodes.select("node", "size", "prefix").join(F.broadcast(changed) if changed.count() <= BROADCAST_NODES else changed, "node", "left_anti")
        nodes = stored(kept.unionByName(again))
    met = cut(meetings(nodes))
    # sizes x and y; the first shingle that two sets share is at i and j of their orders
    fits = f"100 * least(x, y) >= {percent} * greatest(x, y) and {100 + percent} * least(x - i, y - j) >= {percent} * (x + y)"

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, their sizes x, y) that are similar."""
        ends = lambda: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        side = lambda df, c, name: df.select(F.col("node").alias(name), F.col(c).alias(f"of_{name}"))
        rough = texts_of(ends(), lambda t: sketch(t, shingle), "counts")
        met_ = pairs.join(side(rough, "counts", "a"), "a").join(side(rough, "counts", "b"), "b").withColumn("most", most_shared(F.col("of_a"), F.col("of_b")))
        pairs = cut(met_.where(f"most is null or {100 + percent} * most >= {percent} * (x + y)").select("a", "b"))
        whole = texts_of(ends(), lambda t: whole_set(t, shingle), "items")
        joined = pairs.join(side(whole, "items", "a"), "a").join(side(whole, "items", "b"), "b")
        return cut(joined.where(similar(F.col("of_a"), F.col("of_b"), percent)).select("a", "b"))

    stars = met.where("first.node != node").selectExpr("first.node as a", "node as b", "first.size as x", "size as y", "first.at as i", "at as j").where(fits)
    # of the smallest nodes that a node meets, the one it meets most often is likely to be its group's
    often = stars.groupBy("a", "b", "x", "y").agg(F.count("*").alias("times"))
    best = often.groupBy("b").agg(F.max(F.struct("times", "a", "x", "y")).alias("m"))
    tested = cut(best.select("m.a", "b", "m.x", "m.y"))
    links = verified(tested)
    roots = cut(components(links))
    # bundles: nodes of one component, or unlinked ones that met one partner most often, all of about one size
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_NODES else df
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    partner = tested.select(F.col("b").alias("node"), F.col("a").alias("partner"))
    own = nodes.select("node", "size").join(small(linked), "node", "left").join(small(partner), "node", "left")
    kind = F.floor(F.log(F.greatest("size", F.lit(1))) / log(100 / percent)).alias("kind")
    key = F.struct(F.col("root").isNotNull().alias("linked"), F.coalesce("root", "partner", "node").alias("by"), kind).alias("key")
    own = cut(own.select("node", "size", F.coalesce("root", "node").alias("root"), key))
    counts = own.groupBy("key").agg(F.count("*").alias("members"), F.ceil(F.greatest(F.count("*") / BUNDLE, F.sum("size") / BUNDLE_ITEMS)).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    own = cut(join_counted(own, counts, ["key"]).select("node", "size", "root", F.xxhash64("key.linked", "key.by", "key.kind", part).alias("bundle")))
    tokens = met.select("token", "node", "at").join(small(own), "node").groupBy("token", "bundle").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("size") - F.col("at")).alias("room"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    tokens = cut(tokens)
    a, b = tokens.alias("a"), tokens.alias("b")
    # sizes and rooms that some two of them may have
    may = f"100 * b.most >= {percent} * a.least and 100 * a.most >= {percent} * b.least and {100 + percent} * least(a.room, b.room) >= {percent} * (a.least + b.least)"
    apart = "a.low != b.low or a.high != b.high or a.low != a.high"
    pairs = a.join(b, F.expr(f"a.token = b.token and a.bundle <= b.bundle and ({apart}) and {may}"))
    pairs = cut(pairs.select(F.col("a.bundle").alias("one"), F.col("b.bundle").alias("two")).distinct())
    if pairs.isEmpty():
        return rows, links
    needed = own.join(pairs.select(F.col("one").alias("bundle")).union(pairs.select("two")).distinct(), "bundle")
    rough = cut(needed.join(texts_of(needed.select("node"), lambda t: sketch(t, shingle), "counts"), "node"))
    side = lambda which, c: pairs.join(rough, F.col(c) == F.col("bundle")).select("one", "two", F.lit(which).alias("side"), "node", "root", "size", "counts")
    sides = side(0, "one").unionByName(side(1, "two").where("one != two"))
    near = cut(sides.groupBy("one", "two").applyInArrow(lambda t: near_members(t, percent), "one long, two long, side int, node long, root long"))
    whole = near.join(texts_of(near.select("node"), lambda t: whole_set(t, shingle), "items"), "node")
    more = cut(whole.groupBy("one", "two").applyInArrow(lambda t: bundle_links(t, percent), "a long, b long"))
    return rows, links.unionByName(more)
