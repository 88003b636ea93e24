"""Ordered attempts to take in one of a search's results: up to three in their order, until one succeeds or turns out to be there already.

An attempt's outcome: `unreachable` (no content), `duplicate` (its content is known; the search ends, nothing is new), `refused` (its
content is no acceptable upload), `incomplete` (it was registered, and its processing failed), `ingested` (the search ends), or `not tried`.
What is registered is known to all later attempts, of the same search and of searches behind it. Searches are in the order of their ids.

Searches depend on earlier ones through shared content only, so all are decided at once, round by round: given who registered each
content first, every search is decided alone, and who registered what follows. A round settles at least the searches that wait for
none that is open, and rounds end when nothing changes; it is the outcome of doing one search after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import shared_dir

# fixed value: results that are tried
MOST_RESULTS = 3
STOP = "duplicate", "ingested"
#: Contents (some 100 bytes each) up to which their list is broadcast.
BROADCAST_CONTENTS = 100_000


def attempts(results: DataFrame, known: DataFrame, most: int = MOST_RESULTS, rounds: int = 100) -> DataFrame:
    """query_id, position, identifier, content_hash, outcome of the first results of each search.

    results: query_id, position, identifier, content_hash (null: could not be fetched), refused, completed (booleans; null is false).
    known: content_hash of the documents that are there. Of equal positions the smaller identifier comes first.
    """
    fields = F.struct("position", "identifier", "content_hash", F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce("completed", F.lit(False)).alias("completed"))
    lists = _first(results.select("query_id", fields.alias("r")), most)
    there = known.select("content_hash").where("content_hash is not null").distinct().withColumn("there", F.lit(True))
    each = lists.select("query_id", F.posexplode("tried").alias("i", "r")).select("query_id", "i", "r", F.col("r.content_hash").alias("content_hash"))
    each = each.join(there, "content_hash", "left").select("query_id", "i", "r", F.col("there").isNotNull().alias("there"))
    shared_dir(results.sparkSession)
    each = each.checkpoint(eager=True)
    firsts = each.select(F.col("r.content_hash").alias("content_hash"), F.col("query_id").alias("owner")).where("false")
    before = None
    for _ in range(rounds):
        done = _decided(each, firsts).checkpoint(eager=True)
        made = done.where(F.col("outcome").isin("incomplete", "ingested")).groupBy("content_hash").agg(F.min("query_id").alias("owner"))
        firsts = made.checkpoint(eager=True)
        stamp = tuple(firsts.agg(F.count("*"), F.bit_xor(F.xxhash64("content_hash", "owner"))).first())
        if stamp == before:
            return done
        before = stamp
    raise RuntimeError(f"attempts: outcomes still change after {rounds} rounds")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """query_id, tried: the first results in order."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("r.position", "r.identifier"))
    return rows.withColumn("place", place).where(F.col("place") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("tried"))


def _decided(each: DataFrame, firsts: DataFrame) -> DataFrame:
    """The outcomes if the owners of firsts are the first to register each content."""
    owners = F.broadcast(firsts) if firsts.count() <= BROADCAST_CONTENTS else firsts
    told = each.join(owners, each["r.content_hash"] == firsts["content_hash"], "left").select(
        "query_id", "i", "r", (F.col("there") | F.coalesce(F.col("owner") < F.col("query_id"), F.lit(False))).alias("known")
    )
    lists = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "r", "known"))).alias("tried"))
    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("own"), F.array().cast("array<string>").alias("outcomes"))

    def step(s: Column, x: Column) -> Column:
        again = F.array_contains(s["own"], x["r"]["content_hash"])
        outcome = (
            F.when(s["over"], "not tried")
            .when(x["r"]["content_hash"].isNull(), "unreachable")
            .when(x["r"]["refused"], "refused")
            .when(x["known"] | F.coalesce(again, F.lit(False)), "duplicate")
            .when(x["r"]["completed"], "ingested")
            .otherwise("incomplete")
        )
        own = F.when(outcome == "incomplete", F.concat(s["own"], F.array(x["r"]["content_hash"]))).otherwise(s["own"])
        return F.struct((s["over"] | outcome.isin(*STOP)).alias("over"), own.alias("own"), F.concat(s["outcomes"], F.array(outcome)).alias("outcomes"))

    found = lists.withColumn("outcomes", F.aggregate("tried", start, step)["outcomes"])
    out = found.select("query_id", F.explode(F.arrays_zip(F.col("tried.r").alias("r"), F.col("outcomes").alias("outcome"))).alias("x"))
    return out.select("query_id", "x.r.position", "x.r.identifier", "x.r.content_hash", "x.outcome")


def new_documents(tried: DataFrame) -> DataFrame:
    """query_id, identifier of the searches that brought a document in."""
    return tried.where("outcome = 'ingested'").select("query_id", "identifier")
