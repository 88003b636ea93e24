"""Streaming intake, an extension: files that land in a folder go through the batch operators as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.operators.ingest import content_hash, write_partitions


def landing(spark: SparkSession, path: str, schema: str | StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_uploads(stream: DataFrame, content: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each content once within the watermark, whatever the order of arrival."""
    return stream.withColumn("file_hash", content_hash(F.col(content))).withWatermark(time, late).dropDuplicatesWithinWatermark(["file_hash"])


def counted(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Rows by window of event time and keys; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def index_stream(pages: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, partition: str = "document_id") -> StreamingQuery:
    """Each micro-batch's documents are indexed anew and replace their partitions, so a repeated batch changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        write_partitions(transform(df), out, partition)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
