"""Profiles of conversations as a stream: one state a conversation, folded turn by turn as `rules.fold_profiles` does on a table.

What a value means in the controlled vocabularies is worked out by column functions before the stateful step; the step itself only
compares, keeps and replaces. A row comes out for each turn: the profile after it and the conflicts it raised. A turn that is
not behind the last one folded is late: it is reported and changes nothing. A conversation without a turn for the idle time is
closed: its last profile comes out once more and its state goes; a turn after that starts anew.

Defined results: turns of one batch are folded in their order, nulls first, those of equal turn in the order of their updates as
text; a null conversation is one of its own. The state store is the one on disk, since profiles outgrow memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillspark.functions import fixed_values as V
from quillspark.functions import text as T
from quillspark.operators import rules

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of each settled value its meaning, and the meaning that its meaning has once it is stored.
MEANINGS = {"product_category": T.category, "intended_use": T.intended_use}
CONFLICT = "array<struct<field:string,old:string,new:string>>"


def prepared(updates: DataFrame, fields: Sequence[str] = V.PROFILE_FIELDS) -> DataFrame:
    """conversation_id, turn, entries, the fields, and what the settled ones mean, from updates (conversation_id, turn, updates: a map)."""
    new = {f: F.element_at("updates", F.lit(f)).alias(f) for f in fields}
    rows = updates.select("conversation_id", F.col("turn").cast("long").alias("turn"), F.to_json(F.map_entries("updates")).alias("entries"), *new.values())
    means = [c for f, mean in MEANINGS.items() for c in (mean(F.col(f)).alias(f"{f}_means"), mean(mean(F.col(f))).alias(f"{f}_meant"))]
    return rows.select("*", *means, T.heater_type(F.col("product_type")).alias("heater_type"))


class Profile(StatefulProcessor):
    """The state: the last turn, the fields, and what the settled ones mean."""

    def __init__(self, columns: Sequence[str], fields: Sequence[str], idle: float | None) -> None:
        self.columns, self.fields, self.idle = list(columns), list(fields), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = [*self.fields, *(f"{f}_means" for f in MEANINGS)]
        self.handle, self.names = handle, kept
        self.state = handle.getValueState("profile", "turn bigint, " + ", ".join(f"{name} string" for name in kept))

    def _row(self, key: Any, turn: int | None, now: dict[str, str | None], conflicts: list[dict], kind: str) -> Row:
        return Row(conversation_id=key, turn=turn, **{f: now[f] for f in self.fields}, conflicts=conflicts, kind=kind)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told = [dict(zip(self.columns, r, strict=True)) for r in rows]
        place = lambda turn: (turn is not None, turn or 0)
        last, now = None, dict.fromkeys(self.names)
        kept = self.state.get()
        if kept is not None:
            turn, *values = kept
            last, now = place(turn), dict(zip(self.names, values, strict=True))
        newest = None
        for r in sorted(told, key=lambda r: (place(r["turn"]), r["entries"])):
            turn = r["turn"]
            if last is not None and place(turn) <= last:
                yield self._row(key[0], turn, now, [], "late")
            else:
                now, conflicts = self.folded(now, r)
                newest = (turn,)
                yield self._row(key[0], turn, now, conflicts, "turn")
        if newest:
            self.state.update((newest[0], *(now[name] for name in self.names)))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle))

    def folded(self, old: dict[str, str | None], new: dict[str, str | None]) -> tuple[dict[str, str | None], list[dict]]:
        """The profile after a turn, and the conflicts that it raised."""
        now = {f: new[f] if old[f] is None else old[f] for f in self.fields} | {f"{f}_means": old[f"{f}_means"] for f in MEANINGS}
        conflicts = []
        for f in MEANINGS:  # the category is settled first, the use is then put in its terms
            mean, meant = new[f"{f}_means"], old[f"{f}_means"]
            differs = old[f] != new[f]
            replaces = differs and mean is not None and meant is None
            if new[f] is not None and old[f] is not None and differs and None not in (mean, meant) and mean != meant:
                conflicts.append({"field": f, "old": meant, "new": mean})
            now[f] = old[f]
            if new[f] is not None and (old[f] is None or replaces):
                settled = f == "product_category" or now["product_category"] == "water_heater"
                now[f] = mean if settled and mean is not None else new[f]
                now[f"{f}_means"] = new[f"{f}_meant"] if settled and mean is not None else mean
        heater = new["heater_type"] if now["product_category"] == "water_heater" and new["heater_type"] is not None else new["product_type"]
        now["product_type"] = heater if old["product_type"] is None else old["product_type"]
        return now, conflicts

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            turn, *values = self.state.get()
            self.state.clear()
            yield self._row(key[0], turn, dict(zip(self.names, values, strict=True)), [], "closed")

    def close(self) -> None:
        pass


def profile_stream(updates: DataFrame, fields: Sequence[str] = V.PROFILE_FIELDS, idle: float | None = None) -> DataFrame:
    """conversation_id, turn, the fields, questions, kind (turn, late or closed) of a stream of updates; idle in seconds."""
    kind = updates.schema["conversation_id"].dataType.simpleString()
    columns = f"conversation_id {kind}, turn bigint, {', '.join(f'{f} string' for f in fields)}, conflicts {CONFLICT}, kind string"
    mode = "None" if idle is None else "ProcessingTime"
    rows = prepared(updates, fields)
    rows = rows.groupBy("conversation_id").transformWithState(Profile(rows.columns, fields, idle), columns, "Update", mode)
    asked = F.transform("conflicts", lambda c: F.when(c["field"] == "product_category", rules.category_text(c["old"], c["new"])).otherwise(rules.use_text(c["old"], c["new"])))
    return rows.select("conversation_id", "turn", *fields, asked.alias("questions"), "kind")


def start(profiles: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs the stream over what has landed, or, as an idle time needs it, every so often until it is stopped.

    A batch's rows are a folder of their own, which a repeated batch writes again.
    """
    spark = profiles.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    write = profiles.writeStream.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    try:
        when = {"availableNow": True} if every is None else {"processingTime": every}
        return write.outputMode("update").option("checkpointLocation", checkpoint).trigger(**when).start()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def last_profiles(spark: SparkSession, out: str) -> DataFrame:
    """Of each conversation the row of the last turn that was folded."""
    rows = spark.read.parquet(out).where("kind = 'turn'")
    fields = [c for c in rows.columns if c not in ("conversation_id", "kind", "batch")]
    best = F.max_by(F.struct(*fields), F.struct(F.col("turn").isNotNull(), "turn", "batch"))
    return rows.groupBy("conversation_id").agg(best.alias("p")).select("conversation_id", "p.*")
