"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the five ASCII controls tab to carriage return.
SPACES = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    Where none is configured, a folder of this machine serves a local session, as in tests; on a cluster that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, as a table in the shared folder. For loops of joins: a checkpoint hands down the size that was
    estimated for its plan, which a few rounds multiply beyond bounds; a table has the size that it has."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer splits than there are cores; such an input is small, and dealing it out is cheap."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes; null becomes empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that name a row by its id and text. Repeated rows share it; null and empty differ from each other."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), "?").otherwise(":"), F.coalesce(text, F.lit("")))))


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(text_bytes(text)))


#: Keys that each hold more than this share of all rows are fewer than its inverse, and those of fewer than HOT_ROWS rows are not hot anywhere.
HOT_SHARE, HOT_ROWS = 1e-5, 100


def hot_rows(total: int) -> float:
    """Keys with more rows than this, of total, are hot."""
    return max(HOT_ROWS, HOT_SHARE * total)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], members: str = "members", total: int | None = None) -> DataFrame:
    """rows joined with counted (unique by keys, with the number of rows of each), without members. total: of all rows, where it is known.

    Keys with more than HOT_ROWS rows and HOT_SHARE of all are at most 100,000; they are broadcast, so a hot key's rows
    stay where they are. What is left for the shuffle has no hot key. Where no key is hot, nothing is broadcast.
    """
    extra = [c for c in counted.columns if c not in keys and c != members]
    if total is None:
        total, most = counted.agg(F.sum(members), F.max(members)).first()
        total = total or 0
        if (most or 0) <= hot_rows(total):
            return rows.join(counted.select(*keys, *extra).hint("merge"), keys)
    hot = F.col(members) > hot_rows(total)
    many = counted.where(hot).select(*keys, *extra)
    known = rows.join(F.broadcast(many.withColumn("is_hot", F.lit(True))), keys, "left")
    rest = known.where("is_hot is null").drop("is_hot", *extra).join(counted.where(~hot).select(*keys, *extra), keys)
    return known.where("is_hot is not null").drop("is_hot").unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
