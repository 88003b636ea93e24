"""Mixing sources to target weights by entropy balancing.

Sources share a budget by weight, each at most `cap` times its own size. Within
a source, document rates r solve

    minimise  sum r log r - r   subject to   sum r * size = target,  r <= cap

whose solution is r = min(cap, exp(dual * size / mean size)): one dual a
source. The convex dual is solved by Newton steps, each one Spark aggregation
over (source, size) cells; a bracket around each dual keeps the steps safe.
Rates become whole copies by carrying the rounding error from the largest size
to the smallest, so a source's total misses its target by about half of its
smallest document at most, unless that would take more than `cap` copies.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, ordered last; repeated rows count as separate documents; an
empty table gives an empty table; extra columns do not matter. Ties within a
cell are broken by a hash of the document id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import HOT_SHARE, cut, fresh, join_counted, row_key, stored

#: Sources up to which their table (some 60 bytes a row) is broadcast; above, joins shuffle.
BROADCAST_SOURCES = 20_000
#: Sources and sizes that one task sums in a Newton step. A step of no more is planned without an exchange and without a broadcast:
#: the driver keeps a thread and memory for each of them, however small it is, for as long as a minute.
TASK_CELLS = 200_000
#: Documents of one source and size that one task ranks, or HOT_SHARE of all if that is more; larger cells are dealt to sub-cells.
CELL_ROWS = 1_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with n, the row's place from 0 in the order given, without one task that sees all rows."""
    parts = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(before), "part").withColumn("n", F.col("before") + place - 1).drop("part", "before")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: int) -> DataFrame:
    """skey, source_size, n_docs (those with words), target; weights repeat over the sources in their order."""
    sources = sized.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights) + 1).cast("int"))
    sources = cut(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight))
    limit = cap * F.col("source_size").cast("double")
    budget, free = sources.agg(share * F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level = float(budget) / free
    while True:  # each turn holds more sources at their cap; the excess raises the level of the rest
        over = F.col("weight") * level > limit
        held, free = sources.agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        raised = (float(budget) - held) / free if free else level
        if not free or raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.select("skey", "source_size", "n_docs", F.least(F.col("weight") * level, limit).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, cap: int, tolerance: float = 1e-7, most: int = 60) -> DataFrame:
    """targets with the dual of each source that is neither empty nor at its cap (else null).

    The bracket halves where a Newton step leaves it, so `most` steps are far more than any target needs; duals that
    still miss their targets then are an error.
    """
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-9))
    duals = stored(
        targets.select(
            "*",
            F.when(open_, F.lit(0.0)).alias("dual"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.when(open_, F.lit(1.0)).alias("miss"),
        )
    )
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("dual") * x, F.lit(50.0))))
    few_sources = duals.count() <= BROADCAST_SOURCES
    in_one = few_sources and cells.count() <= TASK_CELLS
    cells = cells.coalesce(1) if in_one else cells
    duals = duals.coalesce(1) if few_sources else duals
    for _ in range(most):
        words = F.col("n_cell") * F.col("size")
        sums = [
            F.sum(F.when(F.col("miss").isNotNull(), words * rate)).alias("got"),
            F.sum(F.when(F.col("miss").isNotNull() & (rate < cap), words * x * rate).otherwise(0.0)).alias("slope"),
        ]
        if in_one:
            stepped = duals.join(cells.hint("merge"), "skey", "left").groupBy(*duals.columns).agg(*sums)
        else:
            met = cells.join(F.broadcast(duals) if few_sources else duals, "skey").where("miss is not null")
            stepped = duals.join(met.groupBy("skey").agg(*sums), "skey", "left")
        miss = F.col("got") / F.col("target") - 1
        low = F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        safe = F.col("slope").isNotNull() & (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        inside = F.when(low.isNull(), high - 2 * (1 + F.abs(high))).when(high.isNull(), low + 2 * (1 + F.abs(low))).otherwise((low + high) / 2)
        done = F.abs(miss) <= tolerance
        new = F.when(F.col("got").isNull() | done, F.col("dual")).when(safe, newton).otherwise(inside)
        duals = stored(
            stepped.select(
                *targets.columns, new.alias("dual"), low.alias("low"), high.alias("high"),
                F.when(F.col("got").isNotNull() & ~done, F.abs(miss)).alias("miss")
            )
        )
        duals = duals.coalesce(1) if few_sources else duals
        if not duals.agg(F.count("miss")).first()[0]:
            break
    else:
        raise RuntimeError(f"balance: targets are still missed after {most} steps")
    return duals.select(*targets.columns, "dual")


def whole_copies(cells: DataFrame, duals: DataFrame, cap: int) -> DataFrame:
    """cells (skey, size, sub, n_sub) with the copies that each takes in all."""
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    free = F.least(F.lit(float(cap)), F.exp(F.least(F.col("dual") * x, F.lit(50.0))))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("dual").isNull(), float(cap)).otherwise(free)

    def carry(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "sub"], ascending=[False, True])
        copies, error = [], 0.0
        for size, n, r in zip(part["size"].tolist(), part["n_sub"].tolist(), part["rate"].tolist(), strict=True):
            want = n * r + error / size
            taken = int(min(cap * n, max(0, want + 0.5)))
            error = (want - taken) * size
            copies.append(taken)
        return part.assign(copies=copies)[["skey", "size", "sub", "n_sub", "copies"]]

    return (
        cells.join(duals, "skey").select("skey", "size", "sub", "n_sub", rate.alias("rate"))
        .groupBy("skey").applyInPandas(carry, "skey string, size long, sub long, n_sub long, copies long")
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5, cap: int = 2, key: Column | None = None
) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (its source's), copies, taken; and key, where one is given.

    weights: of the sources by code point, repeating. share: the budget, as a multiple of all sizes.
    """
    skey = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), skey.alias("skey"), n_words(F.col(text)).alias("size")]
    sized = cut(docs.select(*columns, *([key.alias("key")] if key is not None else [])))
    cells = stored(sized.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n_cell")))
    duals = balance(cells, source_targets(sized, weights, share, cap), cap)
    # cells above HOT_SHARE of all documents are at most 1 / HOT_SHARE, so their table is safe to broadcast
    most = max(CELL_ROWS, int(HOT_SHARE * sized.count()))
    parts = cells.where(F.col("n_cell") > most).select("skey", "size", F.ceil(F.col("n_cell") / most).alias("parts"))
    dealt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit("sub")), "parts")).otherwise(0).cast("long")
    placed = sized.join(F.broadcast(parts), ["skey", "size"], "left").withColumn("sub", dealt)
    order = Window.partitionBy("skey", "size", "sub").orderBy(F.xxhash64("doc_id"), "doc_id")
    subs = placed.where("size > 0").groupBy("skey", "size", "sub").agg(F.count("*").alias("n_sub"))
    copies = whole_copies(subs, duals, cap)
    ranked = placed.where("size > 0").withColumn("rank", F.row_number().over(order)).join(copies, ["skey", "size", "sub"])
    own = F.expr("copies div n_sub + if(rank <= copies % n_sub, 1, 0)").cast("long")
    rows = ranked.withColumn("own", own).select(*sized.columns, "own").unionByName(sized.where("size = 0").withColumn("own", F.lit(0).cast("long")))
    sources = duals.select("skey", "source_size", "target", F.greatest("n_docs", F.lit(1)).alias("members"))
    return join_counted(rows, sources, ["skey"]).select(
        "doc_id", "size", "source_size", "target", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"), *(["key"] if key is not None else [])
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their copies and taken words; repeated rows become one with the sum of their copies.

    The new columns are copies and taken, with underscores after them where docs has such columns.
    """
    key = row_key(F.col("doc_id"), F.concat(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))))
    own, copies, words = (fresh(docs, name) for name in ("mix_key", "copies", "taken"))
    taken = mix(docs, key=key, **options).where("copies > 0").groupBy(F.col("key").alias(own)).agg(F.sum("copies").alias(copies), F.sum("taken").alias(words))
    return docs.withColumn(own, key).dropDuplicates([own]).join(taken, own).drop(own)


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
