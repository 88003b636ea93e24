"""Named queries that stream a table in several batches and give what a batch query gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.tables import table
from quillspark.session import shared_dir
from quillspark.streaming import intake, landing, profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _landed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """rows added to a landing folder, and the folder as a stream."""
    rows.write.mode("append").parquet(f"{folder}/in")
    return landing.landing(spark, f"{folder}/in", rows.schema, 100_000)


@query
def profile_stream(spark, sf_dir):
    """Conversations fold into profiles as their turns land, over three streams that each go on where the last one ended."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    said = F.create_map(
        F.lit("product_category"), F.when(F.col("role") == "assistant", "geyser").otherwise("appliance"), F.lit("capacity"),
        F.concat("turn", F.lit(" L"))
    )
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", said.alias("updates"))
    for part in ("turn < 2 or turn is null", "turn between 2 and 4", "turn > 4"):
        updates = _landed(spark, turns.where(part), folder)
        profiles.start(profiles.profile_stream(updates), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    rows = profiles.last_profiles(spark, f"{folder}/out")
    return rows.select("conversation_id", "product_category", "capacity", F.size("questions").alias("n_questions"))


ORACLES["profile_stream"] = """
    SELECT conv_id AS conversation_id, CASE WHEN bool_or(role = 'assistant') THEN 'water_heater' ELSE 'appliance' END AS product_category,
        arg_min(turn || ' L', turn) AS capacity, 0 AS n_questions
    FROM conversations GROUP BY conv_id"""


@query
def upload_stream(spark, sf_dir):
    """E10, K: uploads land in three batches, the second is taken in twice; the first upload of each content is new, whenever copies come."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in range(3):
        intake.start(_landed(spark, docs.where(F.col("doc_id") % 3 == part), folder), folder, "text", "doc_id").awaitTermination()
    intake.intake(folder, "text", "doc_id")(docs.where("doc_id % 3 = 1"), 1)
    return spark.read.parquet(f"{folder}/outcomes").select("doc_id", "of", "outcome")


ORACLES["upload_stream"] = """
    WITH f AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id % 3, doc_id) AS "of" FROM documents)
    SELECT doc_id, "of", CASE WHEN doc_id = "of" THEN 'new' ELSE 'duplicate' END AS outcome FROM f"""
