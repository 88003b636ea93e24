"""States of documents from the events of their processing: an ordered fold that takes legal steps only and reports the others.

An event is a function from states to states, and functions compose in any grouping, so one document's events need not meet in
one task: events are sorted over all tasks, each task's part of a document is cut into blocks of `BLOCK` events, and a block
becomes what it does to each state. Blocks are composed within a part and parts within a document, which says in
what state each block is entered; then each block is run through again where it is.

Defined results: events of one document are in the order of the given columns, nulls first, and then of the status, so equal ones are alike;
an unknown or null status is illegal; a null document is one of its own; no events give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of a block.
BLOCK = 128

# fixed values: the state a document starts in, and the steps it may take
START = "uploaded"
STEPS = {
    "uploaded": ["processing", "failed"],
    "processing": ["text_extracted", "failed"],
    "text_extracted": ["features_extracted", "failed"],
    "features_extracted": ["completed", "failed"],
    "completed": [],
    "failed": [],
}


def step(state: Column, status: Column, steps: Mapping[str, Sequence[str]] = STEPS) -> Column:
    """The state after an event: the status where that is a legal step, or the same."""
    legal = F.lit(False)
    for origin, ends in steps.items():
        if ends:
            legal = legal | ((state == origin) & status.isin(*ends))
    return F.when(F.coalesce(legal, F.lit(False)), status).otherwise(state)


def transitions(
    events: DataFrame, key: str, order: Sequence[str], status: str = "status", steps: Mapping[str, Sequence[str]] = STEPS, start: str = START
) -> DataFrame:
    """The order's columns, key, status, and each event's before, after (states) and accepted."""
    names = list(steps)
    first = F.asc_nulls_first
    rows = events.select(F.col(key).alias("doc"), F.struct(*order).alias("at"), F.col(status).cast("string").alias("status"))
    by = [first(f"at.{c}") for c in order] + [first("status")]
    sorted_ = rows.repartitionByRange(first("doc"), *by).withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("doc", "part").orderBy(*by))
    event = F.struct("number", "at", "status")
    blocks = sorted_.withColumn("number", number).withColumn("block", F.floor((F.col("number") - 1) / BLOCK))
    blocks = blocks.groupBy("doc", "part", "block").agg(F.array_sort(F.collect_list(event)).alias("events"))
    run = lambda s: F.aggregate("events", s, lambda a, e: step(a, e["status"], steps))
    blocks = blocks.withColumn("does", F.array(*(run(F.lit(s)) for s in names)))
    after = lambda state, does: F.get(does, F.array_position(F.array(*map(F.lit, names)), state).cast("int") - 1)
    folded = lambda does, s: F.aggregate(does, s, lambda a, d: after(a, d["does"]))
    # what each part does, and the state in which it is entered
    inner = blocks.groupBy("doc", "part").agg(F.array_sort(F.collect_list(F.struct("block", "does"))).alias("inner"))
    parts = inner.withColumn("does", F.array(*(folded(F.col("inner"), F.lit(s)) for s in names)))
    all_parts = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("part", "does"))).alias("parts"))
    entries = lambda does, s: F.aggregate(
        does, F.struct(s.alias("now"), F.array().cast("array<string>").alias("seen")),
        lambda a, d: F.struct(after(a["now"], d["does"]).alias("now"), F.concat(a["seen"], F.array(a["now"])).alias("seen")),
    )["seen"]
    entry = F.arrays_zip(F.col("parts.part").alias("part"), F.col("seen").alias("entry"))
    whole = all_parts.withColumn("seen", entries(F.col("parts"), F.lit(start))).select("doc", F.explode(entry).alias("x"))
    whole = whole.select("doc", "x.part", "x.entry")
    entered = parts.alias("p").join(whole.alias("w"), F.col("p.part").eqNullSafe(F.col("w.part")) & F.col("p.doc").eqNullSafe(F.col("w.doc")))
    entered = entered.select("p.doc", "p.part", "p.inner", "w.entry").withColumn("seen", entries(F.col("inner"), F.col("entry")))
    each = F.arrays_zip(F.col("inner.block").alias("block"), F.col("seen").alias("entry"))
    entered = entered.select("doc", "part", F.explode(each).alias("x")).select("doc", "part", "x.block", "x.entry")
    same = lambda c: F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}"))
    told = blocks.alias("b").join(entered.alias("e"), same("doc") & same("part") & same("block")).select("b.doc", "b.events", "e.entry")
    # at most BLOCK events: a running state for each
    states = F.aggregate("events", F.array("entry"), lambda a, e: F.concat(a, F.array(step(F.element_at(a, -1), e["status"], steps))))
    told = told.withColumn("states", states)
    out = F.transform("events", lambda e, i: F.struct(e["at"].alias("at"), e["status"].alias("status"), F.get("states", i).alias("before"), F.get("states", i + 1).alias("after")))
    out = told.select(F.col("doc").alias(key), F.explode(out).alias("e")).select(key, "e.at.*", F.col("e.status").alias(status), "e.before", "e.after")
    return out.withColumn("accepted", F.col("before") != F.col("after"))


def final_states(found: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """key, state, n_accepted, n_illegal of the rows that transitions gives."""
    last = F.max_by("after", F.struct(F.col("accepted"), *order))
    state = F.when(F.bool_or("accepted"), last).otherwise(F.min("before"))
    return found.groupBy(key).agg(state.alias("state"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_illegal"))
