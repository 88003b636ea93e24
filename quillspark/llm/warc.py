"""Content-addressed web archive.

A page becomes a WARC record. Payload bytes are stored once, in a table keyed by
their SHA-256; record headers are stored apart, byte for byte. A record is put
together again by a join on the digest, which is computed anew from the stored
bytes and must agree.

Of records with equal payloads of at least `REVISIT_BYTES` the one with the smallest
page_id is a response, the others are revisits that refer to it.

Defined results: null html is an empty payload; a null url leaves out its header; a
null page_id is larger than all others; ids may be of any type that a string can hold, and are compared as what they are; repeated rows that are the smallest are all
responses; an empty table gives an empty archive; extra columns do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, join_counted, shared_dir, text_bytes

REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def record_header(date: str = DATE) -> Column:
    """A record's header lines, from page_id, url, digest, n_bytes, kind and refers_to."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("kind") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", record_uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_uri(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def record_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, n_bytes, kind, refers_to of pages (page_id, url, payload)."""
    rows = pages.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    first = cut(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("members")))
    revisit = (F.col("n_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return join_counted(rows, first, ["digest"]).select(
        "page_id", "url", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to")
    )


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """path/records: header, digest; path/payloads: digest, payload, each digest once."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_bytes(F.col(html)).alias("payload"))
    record_kinds(own).select(record_header().cast("binary").alias("header"), "digest").write.parquet(f"{path}/records")
    # equal payloads meet inside each task first, so a payload that very many pages share moves once a task
    own.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def field(name: str) -> Column:
    """A header field, or null."""
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_headers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The records of an archive by their headers: header, digest, page_id (of the type given), url, kind, refers_to, payload_digest."""
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(.*)>$", 1)
    return spark.read.parquet(f"{path}/records").select(
        "header",
        "digest",
        F.nullif(page("WARC-Record-ID"), F.lit("")).cast(id_type).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("kind"),
        F.nullif(page("WARC-Refers-To"), F.lit("")).cast(id_type).alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"^sha256:(.*)$", 1).alias("payload_digest"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload; a payload whose bytes don't have the digest stops the read."""
    good = F.sha2("payload", 256) == F.col("digest")
    return spark.read.parquet(f"{path}/payloads").select(
        "digest",
        F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload damaged: "), "digest")).cast("binary")).alias("payload")
    )


def read_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, kind and record, the original bytes of every record."""
    body = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read_headers(spark, path, id_type).join(read_payloads(spark, path), "digest").select(
        "page_id", "kind", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record")
    )


def op2(pages: DataFrame) -> DataFrame:
    """Writes the archive, reads it back, and tells of each record what it holds."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    stored = read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return read_headers(spark, path, dict(pages.dtypes)["page_id"]).join(stored, "digest").select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"
    )
