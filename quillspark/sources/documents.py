"""Sources: folders of files, page texts, scanned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T
from quillspark.operators.ingest import content_hash, reject_reason


def pdf_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, content, file_hash, reject_reason of a folder's PDF files; a bad file is a row, not an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("file_name"), "content", content_hash(F.col("content")).alias("file_hash"),
        reject_reason(F.col("content"), F.lit("application/pdf"), name).alias("reject_reason")
    )


def page_method(text: Column) -> Column:
    """native where the page's own text is long enough, else ocr."""
    return F.when(F.length(T.strip(text)) >= V.LEAST_NATIVE_CHARS, "native").otherwise("ocr")


def pages_from_words(words: DataFrame) -> DataFrame:
    """document_id, page_number, text, ocr_confidence from recognised words (document_id, page_number, pos, word, confidence).

    Words that are blank give no text; confidences below 0 are left out; the mean is over 100, null if none.
    """
    said = F.col("word").isNotNull() & (F.length(T.strip(F.col("word"))) > 0)
    return words.groupBy("document_id", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said, F.struct("pos", "word")))), lambda x: x["word"]), " ").alias("text"),
        (F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))) / 100).alias("ocr_confidence"),
    )
