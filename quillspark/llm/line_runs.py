"""Line dedup: a suffix array over line ids, by distributed prefix doubling.

All documents' lines form one sequence, in the order of doc_id. A suffix starts at
each line and ends with its document. The rank of a suffix by its first h lines is
the number of repeated suffixes that sort before those lines; doubling ranks the
pairs of ranks at the suffix and h lines on, so that a class of suffixes with the
same rank is an interval of the suffix array whose longest common prefix is h lines
at least, and a round splits it into the intervals of twice the depth within it.
Suffixes that leave their interval alone, or have no lines left, are settled; the
rounds go on until all are.

Of an interval the suffix that comes first in the sequence stays. For every other
one the deepest interval in which it is not the first says how long a copy starts
there, and of what. Copies that go on from line to line, of one first source, are one
repeated run of `min_lines` or more; where a line has an earlier source, a run of that
source begins, and together they cover the maximal run. A line of `long_line` characters
or more is a run by itself.
Later copies, also overlapping ones, are deleted.

All of it is DataFrame operations. Classes are counted with partial aggregation, so a
line that is everywhere costs one row a task; very common ones are broadcast, by a
share that bounds their number; ranks are running sums over ranges of the sorted
pairs, with one number a range that everybody knows; the text moves only once, for
the rewrite.

Defined results: a null text stays null and has no lines; a null doc_id comes after
all others; rows that agree in doc_id and text are one document and get the same
result; an empty table gives an empty table; other columns stay as they are, also one
named as the report would be (the report then gets an underscore); a text all of whose
lines go becomes empty. Lines are told apart by 128 bits of their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, join_counted, row_key, stored

MIN_LINES = 4
LONG_LINE = 50
#: Suffixes that one task ranks. A round of no more is planned without an exchange and without a broadcast: the driver keeps a
#: thread and memory for each of them, however small it is, for as long as a minute, and the rounds are many.
TASK_SUFFIXES = 100_000


def numbered_documents(docs: DataFrame, doc_id: str, text: str, long_line: int) -> DataFrame:
    """key, first (the place of the first line among all lines), n, and by line its id and whether it is long."""
    lines = F.split(F.col(text), "\n", -1)
    told = F.transform("lines", lambda x: F.struct(F.substring(F.unhex(F.sha2(x, 256)), 1, 16).alias("id"), (F.length(x) >= long_line).alias("long")))
    rows = docs.where(F.col(text).isNotNull()).select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).cast("long").alias("doc"), lines.alias("lines")
    )
    rows = rows.select("key", "doc", F.size("lines").cast("long").alias("n"), told.alias("told")).dropDuplicates(["key"])
    order = F.col("doc").asc_nulls_last(), F.col("key")
    parts = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return parts.join(F.broadcast(_before(parts, "n")), "part").select("key", (F.col("before") + within).alias("first"), "n", "told")


def _before(parts: DataFrame, value: str) -> DataFrame:
    """part, before: the sum of the value over all parts before it; a row a part."""
    sums = parts.groupBy("part").agg(F.sum(value).alias("all"))
    return sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def ranked(pairs: DataFrame, second: str) -> DataFrame:
    """pairs (name, second, members, ...), one row each, with rank: name and the members of the pairs of that name before this one.

    The pairs are sorted by ranges, so a name that very many pairs share lies in many tasks. Of each range three numbers
    come to the driver, as many rows as there are ranges: its members, and where its first and last name begin.
    """
    parts = stored(pairs.repartitionByRange("name", second).withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("name", second).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.withColumn("sum", F.sum("members").over(order) - F.col("members")).withColumn("start", F.min("sum").over(Window.partitionBy("part", "name")))
    ends = sums.groupBy("part").agg(
        F.sum("members").alias("all"), F.min(F.struct("name", "start")).alias("low"), F.max(F.struct("name", "start")).alias("high")
    ).orderBy("part").collect()
    begins, told, before = {}, [], 0
    for r in ends:
        for name, start in (r["low"], r["high"]):
            begins.setdefault(name, before + start)
        # a range's first name may have begun in one before it
        told.append((r["part"], before, r["low"]["name"], begins[r["low"]["name"]]))
        before += r["all"]
    known = parts.sparkSession.createDataFrame(told, "part int, before long, low long, low_start long")
    rows = sums.join(F.broadcast(known), "part")
    start = F.when(F.col("name") == F.col("low"), F.col("low_start")).otherwise(F.col("before") + F.col("start"))
    return rows.withColumn("rank", F.col("name") + F.col("before") + F.col("sum") - start).select(*pairs.columns, "rank")


def classes(suffixes: DataFrame, second: str) -> DataFrame:
    """The pairs (name, second) that several suffixes share: members, place (of the first), rank."""
    shared = suffixes.groupBy("name", second).agg(F.count("*").alias("members"), F.min("at").alias("place")).where("members > 1")
    return stored(ranked(shared, second))


def ranked_in_one(suffixes: DataFrame, second: str) -> DataFrame:
    """suffixes that share (name, second) with others, with place and rank as of classes, in one task."""
    group = Window.partitionBy("name", second)
    shared = suffixes.coalesce(1).withColumn("members", F.count("*").over(group)).withColumn("place", F.min("at").over(group)).where("members > 1")
    return shared.withColumn("rank", F.col("name") + F.rank().over(Window.partitionBy("name").orderBy(second)) - 1)


def deeper(suffixes: DataFrame, second: str, depth: int, total: int | None = None) -> DataFrame:
    """Suffixes (total in all, where it is known) that share (name, second) with others, with their new rank as name, and of the copy that starts there how long it is and where the first one is."""
    if total is not None and total <= TASK_SUFFIXES:
        rows = ranked_in_one(suffixes, second)
    else:
        rows = join_counted(suffixes, classes(suffixes, second), ["name", second], total=total)
    late = F.col("place") < F.col("at")
    lines = F.least(F.lit(depth).cast("long"), F.col("end") - F.col("at"))
    copied, source = F.when(late, lines).otherwise(F.col("copied")), F.when(late, F.col("place")).otherwise(F.col("source"))
    return stored(
        rows.select(
            "first", "at", "end", F.col("rank").alias("name"), copied.alias("copied"), source.alias("source"), F.lit(depth).alias("depth"),
            second
        )
    )


def line_copies(documents: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of lines that start a later copy: first, at, copied, source of those of min_lines or more; and first, at of all long lines."""
    lines = documents.select("first", "n", F.posexplode("told").alias("i", "t"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    lines = lines.select(
        "first", (F.col("first") + F.col("i")).alias("at"), (F.col("first") + F.col("n")).alias("end"), zero.alias("name"),
        none.alias("copied"), none.alias("source"), "t.id", F.col("t.long").alias("long")
    )
    known = lines.withColumn("id", F.struct("id", "long"))  # a line is long wherever it stands
    suffixes = deeper(known.drop("long"), "id", 1, documents.agg(F.sum("n")).first()[0] or 0)
    late_long = suffixes.where(F.col("copied").isNotNull() & F.col("id.long")).select("first", "at")
    rounds, settled, depth, n, n_settled = [suffixes], None, 1, suffixes.count(), 0
    while n:
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        depth += step
        names = suffixes.select("at", "name") if settled is None else suffixes.select("at", "name").unionByName(settled)
        ahead = names.select((F.col("at") - step).alias("at"), F.col("name").alias("second"))
        own = suffixes.select("first", "at", "end", "name", "copied", "source")
        if n + n_settled <= TASK_SUFFIXES:  # they meet in one task, where they lie
            own, ahead = own.coalesce(1), ahead.coalesce(1).hint("merge")
        more = own.where(F.col("at") + step < F.col("end")).join(ahead, "at")
        # a suffix without further lines sorts before all that go on
        pairs = stored(more.unionByName(own.where(F.col("at") + step >= F.col("end")).withColumn("second", F.lit(-1).cast("long"))))
        found = deeper(pairs, "second", depth, n)
        rounds.append(found)
        ended = found.where("second < 0").select("at", "name")
        settled = ended if settled is None else settled.unionByName(ended)
        suffixes = found.where("second >= 0")
        few = (n + n_settled) // TASK_SUFFIXES + 1
        n, more_settled = found.coalesce(few).agg(F.count_if(F.col("second") >= 0), F.count_if(F.col("second") < 0)).first()
        n_settled += more_settled
    columns = "first", "at", "copied", "source", "depth"
    every = rounds[0].select(*columns)
    for r in rounds[1:]:
        every = every.unionByName(r.select(*columns))
    # a suffix is in all rounds up to where it is settled; what the last of them knows holds
    best = every.where(F.col("copied") >= min_lines).groupBy("first", "at").agg(F.max(F.struct("depth", "copied", "source")).alias("b"))
    return best.select("first", "at", "b.copied", "b.source"), late_long


def by_document(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (first, at, ...) with the key of their document and i, the line's number in it."""
    return rows.join(documents.select("key", "first"), "first").withColumn("i", F.col("at") - F.col("first")).drop("first", "at")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """key (the row_key), gone: the numbers of the lines to delete, sorted; documents that lose none are left out."""
    documents = stored(numbered_documents(docs, doc_id, text, long_line))
    copies, late_long = line_copies(documents, min_lines)
    rows = by_document(documents, copies.drop("source").unionByName(late_long.withColumn("copied", F.lit(1).cast("long"))))
    rows = rows.groupBy("key", "i").agg((F.col("i") + F.max("copied")).alias("to"))
    # each line of a run starts a copy: what those before already cover is not spread again
    reach = F.max("to").over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("from", F.greatest("i", F.coalesce(reach, F.lit(0)))).where("from < to")
    lines = new.select("key", F.explode(F.sequence("from", F.col("to") - 1)).alias("line"))
    return lines.groupBy("key").agg(F.array_sort(F.collect_list(F.col("line").cast("int"))).alias("gone"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """key, start, end (exclusive), source: the runs that are later copies of one place, as far as that is their first, one row a run; source is the place among all lines."""
    documents = stored(numbered_documents(docs, doc_id, text, long_line))
    copies, _ = line_copies(documents, min_lines)
    rows = by_document(documents, copies).withColumn("shift", F.col("source") - F.col("i"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("key", "shift").orderBy("i"))
    found = rows.withColumn("island", island).groupBy("key", "shift", "island")
    return found.agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("copied")).alias("end"), F.min("source").alias("source")).drop("shift", "island")


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of the sorted numbers given; a mask of one byte a line keeps it linear."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    mask = F.array_join(F.zip_with(gone, before, lambda g, b: F.concat(F.repeat(F.lit("0"), g - b - 1), F.lit("1"))), "").cast("binary")
    masked = F.transform(F.array(mask), lambda m: F.filter(F.split(text, "\n", -1), lambda _, i: F.substring(m, i + 1, F.lit(1)) != F.lit(b"1")))
    return F.array_join(F.get(masked, F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "line_report", **options) -> DataFrame:
    """docs with repeated runs deleted from text, and a new column (named by into): a struct of n_lines (before) and n_removed."""
    into = fresh(docs, into)
    own, gone = fresh(docs, "line_own"), fresh(docs, "line_gone")
    found = repeated_lines(docs, doc_id, text, **options).select(F.col("key").alias(own), F.col("gone").alias(gone))
    rows = docs.withColumn(own, row_key(F.col(doc_id), F.col(text))).join(found, own, "left")
    n_lines = F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0))
    report = F.struct(
        F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed")
    )
    rows = rows.withColumn(into, report)
    return rows.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(gone)))).drop(own, gone)


def op5(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "line_report.n_lines", "line_report.n_removed", "text")
