"""Uploads as a stream, with a registry of all contents ever seen: a copy is one however late it comes.

The registry is a folder with a part for each batch, written inside the batch before its outcomes. A batch looks at the parts of
the batches before it only, and writes its own parts whole, so a batch that is repeated after a failure finds what it found
the first time and leaves the same files. Nothing is forgotten, and nothing is kept in memory between batches.

Defined results: of equal contents of one batch the first in the given order is new; a null content is a content like
others; an empty batch writes empty parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.ingest import content_hash, first_by_content

#: Contents of a batch (some 80 bytes each) up to which their list is broadcast to the registry.
BROADCAST_HASHES = 500_000


def outcomes(batch: DataFrame, registry: DataFrame, content: str, key: str) -> DataFrame:
    """batch with content_hash, of (the key of the first upload of that content) and outcome (new or duplicate).

    registry: content_hash, of.
    """
    rows = first_by_content(batch.withColumn("hashed", F.coalesce(F.col(content).cast("binary"), F.lit(b"\0null"))), "hashed", key).drop("hashed")
    own = rows.select("content_hash").distinct()
    known = registry.join(F.broadcast(own) if own.count() <= BROADCAST_HASHES else own, "content_hash", "left_semi").withColumnRenamed("of", "known_of")
    known = F.broadcast(known) if known.count() <= BROADCAST_HASHES else known
    told = rows.join(known, "content_hash", "left").withColumn("of", F.coalesce("known_of", "first"))
    return told.withColumn("outcome", F.when(F.col(key).eqNullSafe(F.col("of")), "new").otherwise("duplicate")).drop("first", "known_of")


def intake(folder: str, content: str, key: str) -> Callable[[DataFrame, int], None]:
    """What a batch of uploads does: registers its new contents and writes its outcomes, in the folders registry and outcomes."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        earlier = _parts(spark, f"{folder}/registry", f"content_hash string, of {kind}, batch long").where(F.col("batch") < number)
        found = outcomes(batch, earlier.select("content_hash", "of"), content, key)
        found.where("outcome = 'new'").select("content_hash", "of").write.mode("overwrite").parquet(f"{folder}/registry/batch={number}")
        found.drop(content).write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    return run


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The parts of a folder that may not be there yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def start(uploads: DataFrame, folder: str, content: str, key: str) -> StreamingQuery:
    """Takes in what has landed; a start over the same folder goes on behind the last batch."""
    write = uploads.writeStream.foreachBatch(intake(folder, content, key)).option("checkpointLocation", f"{folder}/checkpoint")
    return write.trigger(availableNow=True).start()
