"""Intake and upkeep: validation, content dedup, replacement of a document's rows, cascading deletes, seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V


def reject_reason(content: Column, mime: Column, name: Column, most: int = V.MAX_UPLOAD_BYTES) -> Column:
    """Why an upload is refused, the first reason that holds; null if it is taken."""
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "empty")
        .when(F.octet_length(content) > most, "too large")
        .when(~mime.eqNullSafe(F.lit("application/pdf")), "wrong type")
        .when(~F.startswith(content, F.lit(b"%PDF-")), "not a pdf")
        .when(F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0, "no name")
    )


def checked_type(kind: Column, allowed: Sequence[str] = V.DOCUMENT_TYPES) -> Column:
    """OTHER for none; null for an unknown type."""
    given = F.coalesce(F.nullif(kind, F.lit("")), F.lit("OTHER"))
    return F.when(given.isin(*allowed), given)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


#: Contents that more rows than this and this share of all rows have are fewer than 100,000; they are broadcast.
HOT_ROWS, HOT_SHARE = 1_000, 1e-5


def first_by_content(docs: DataFrame, content: str, order: str) -> DataFrame:
    """docs with content_hash and first: the order value of the first row with that content.

    Rows of a content that very many share, such as a blank page's, stay where they are.
    """
    rows = docs.withColumn("content_hash", content_hash(F.col(content)))
    firsts = rows.groupBy("content_hash").agg(F.min(order).alias("first"), F.count("*").alias("n_alike"))
    many = F.col("n_alike") > max(HOT_ROWS, HOT_SHARE * docs.count())
    hot = F.broadcast(firsts.where(many).select("content_hash", F.col("first").alias("hot_first"), F.lit(True).alias("is_hot")))
    told = rows.join(hot, "content_hash", "left")
    rest = told.where("is_hot is null").drop("is_hot", "hot_first").join(firsts.where(~many).drop("n_alike"), "content_hash", "left")
    return rest.unionByName(told.where("is_hot").drop("is_hot").withColumnRenamed("hot_first", "first"))


def new_only(incoming: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is not there yet: a seed that can run again."""
    return incoming.join(existing.select(key), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the rows of new's keys replaced; keys listed with no rows of their own come by emptied()."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def appended(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows; as a stored table, new.write.mode("append")."""
    return table.unionByName(new)


def reindexed(table: DataFrame, new: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The table with the rows of completed documents (documents: key, status) replaced; those of others stay as they are."""
    return replaced(table, new.join(documents.where("status = 'completed'").select(key), key, "left_semi"), key)


def emptied(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of the keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def write_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Replace whole partitions in one commit: the rows are computed before anything is deleted."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def cascade(tables: Mapping[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted parents."""
    return {name: emptied(t, keys, key) for name, t in tables.items()}


def upserted(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with changed rows in place and new ones added; of several changes of a key the last by order holds."""
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        changes = changes.withColumn("back", F.row_number().over(last)).where("back = 1").drop("back", order)
    return replaced(table, changes, key)


def stage_status(errors: Mapping[str, Column]) -> Column:
    """A document's state from its stages' errors: text and features fail it, the others degrade it."""
    fatal = [errors[s] for s in ("text", "features") if s in errors]
    failed = F.lit(False)
    for e in fatal:
        failed = failed | e.isNotNull()
    return F.when(failed, "failed").otherwise("completed")


def outcomes(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))
