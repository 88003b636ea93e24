"""Catalogue search, parents with children, history: the relational queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def search(rows: DataFrame, words: str | None = None, columns: Sequence[str] = (), equal: dict[str, str | None] | None = None) -> DataFrame:
    """Rows with the words in any of the columns (any case) that equal what is asked; an empty argument filters nothing."""
    if words:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(words.lower()))
        rows = rows.where(hit)
    for c, value in (equal or {}).items():
        if value:
            rows = rows.where(F.col(c) == value)
    return rows


def with_child(rows: DataFrame, children: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Rows that have a child (for which the condition holds), each once."""
    children = children.where(condition) if condition is not None else children
    return rows.join(children.select(key).distinct(), key, "left_semi")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: Sequence[str], name: str = "children") -> DataFrame:
    """Parents with their children as an ordered array, empty where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def bridged(left: DataFrame, links: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows of both sides of a many-to-many link, each pair once; a link to a missing row gives nothing."""
    return left.join(links.distinct(), F.expr(left_on)).join(right, F.expr(right_on))


def users_of(tokens: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """tokens with their session and its user; a token without a session, or whose user is gone, drops out."""
    return tokens.join(sessions, "token").join(users, "user_id")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def display_status(status: Column, n_chunks: Column) -> Column:
    return F.when(status == "failed", "FAILED").when((status == "completed") & (n_chunks > 0), "INDEXED").otherwise("PROCESSING")


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.col(column).isNotNull()).distinct()


def owned_by(rows: DataFrame, owner: Column, column: str = "user_id") -> DataFrame:
    """Null owns what nobody owns, and nothing else."""
    return rows.where(F.col(column).eqNullSafe(owner))


def recent(rows: DataFrame, time: str, key: str, most: int) -> DataFrame:
    """A stated number of rows, newest first."""
    return rows.orderBy(F.desc(time), key).limit(most)


def last_turns(messages: DataFrame, conversation: str, turn: str, most: int) -> DataFrame:
    """The last turns of every conversation."""
    back = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return messages.withColumn("back", F.row_number().over(back)).where(F.col("back") <= most).drop("back")


def sticky(messages: DataFrame, conversation: str, turn: str, signal: Column, name: str = "mode") -> DataFrame:
    """name: whether the signal has held at this turn or before."""
    so_far = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn(name, F.max(F.coalesce(signal, F.lit(False)).cast("int")).over(so_far) == 1)


def titles(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Each conversation's title, from its first message."""
    return messages.groupBy(conversation).agg(F.min_by(text, turn).alias("first")).select(conversation, T.short_title(F.col("first")).alias("title"))


def citations(hits: DataFrame, query: str, key: str, rank: str, columns: Sequence[str]) -> DataFrame:
    """Each key once a query, at its best rank."""
    first = hits.groupBy(query, key).agg(F.min(F.struct(rank, *columns)).alias("m"))
    return first.select(query, key, *(F.col(f"m.{c}").alias(c) for c in (rank, *columns)))


def _ladder_classes(titles_: DataFrame, queries: DataFrame, key: str, title: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(titles: key, ts), (queries: query_id, qs), (found: qs, rung, ts): titles and queries of equal texts as one class each, and which meet.

    ts and qs: the texts of a key, of which there may be several, sorted. Phrases and titles meet on runs of up to three words that both
    have; which rung is a query's follows from the runs that occur at all, so that only its own rung is spread over titles.
    """
    words = lambda text: F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    runs = lambda n: F.when(
        F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))
    classes = lambda rows, key, text, name: rows.select(
        key, F.array_join(words(text), " ").alias("t")
    ).where("t != ''").groupBy(key).agg(F.array_sort(F.collect_set("t")).alias(name))
    titles_, asked = classes(titles_, key, F.col(title), "ts"), classes(queries, "query_id", T.strip(F.col("text")), "qs")
    split = lambda rows, name: rows.select(name).distinct().select(name, F.explode(name).alias("t")).select(name, "t", F.split("t", " ").alias("w"))
    held = split(titles_, "ts").select("ts", F.concat(F.lit(" "), "t", F.lit(" ")).alias("t"), F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("run"))
    rungs = [F.array("t"), runs(3), runs(2), F.filter("w", lambda x: F.length(x) > 2)]
    phrases = split(asked, "qs").select("qs", F.explode(F.array(*(F.struct(F.lit(i).alias("rung"), r.alias("p")) for i, r in enumerate(rungs)))).alias("r"))
    phrases = phrases.select("qs", "r.rung", F.explode("r.p").alias("phrase")).distinct().withColumn("run", F.substring_index("phrase", " ", 3))
    whole = F.contains("t", F.concat(F.lit(" "), "phrase", F.lit(" ")))  # of a phrase of more than three words more than its run
    there = phrases.where("phrase = run").join(held.select("run").distinct(), "run", "left_semi").select("qs", "rung")
    there = there.unionByName(phrases.where("phrase != run").join(held, "run").where(whole).select("qs", "rung"))
    best = there.groupBy("qs").agg(F.min("rung").alias("rung"))
    found = phrases.join(best, ["qs", "rung"]).join(held, "run").where(whole).select("qs", "rung", "ts").distinct()
    return titles_, asked, found


def ladder(titles_: DataFrame, queries: DataFrame, key: str, title: str) -> DataFrame:
    """For each query the titles found by its first rung that finds any: the whole phrase, three words running, two words running, any word of three letters or more.

    queries: query_id, text. Where only numbers of titles are asked for, `ladder_counts` forms no pairs of rows.
    """
    titles_, asked, found = _ladder_classes(titles_, queries, key, title)
    return found.join(asked, "qs").join(titles_, "ts").select("query_id", key, "rung")


def ladder_counts(titles_: DataFrame, queries: DataFrame, key: str, title: str) -> DataFrame:
    """query_id, rung, found, first: the rung of each query that finds any title, how many titles that finds, and their least key.

    Equal titles are counted before they meet queries, and equal queries are answered once.
    """
    titles_, asked, found = _ladder_classes(titles_, queries, key, title)
    sizes = titles_.groupBy("ts").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    answers = found.join(sizes, "ts").groupBy("qs", "rung").agg(F.sum("n").alias("found"), F.min("least").alias("first"))
    return asked.join(answers, "qs").select("query_id", "rung", "found", "first")
