"""Streams against the same work on a table: restarts, repeated batches, late rows, timeouts."""

import contextlib
import random
import time

import pytest
from pyspark.errors import AnalysisException

from quillspark.functions import fixed_values as V
from quillspark.operators import rules
from quillspark.streaming import intake, landing, profiles

UPDATES = "conversation_id string, turn long, updates map<string,string>"
WORDS = {
    "product_category": ["geyser", "water heater", "RO system", "appliance", "water_purifier", None], "intended_use": ["for the home", "industrial", "domestic", "shop", None],
    "product_type": ["tankless", "storage tank", "other", None], "capacity": ["9 L", "25 L", None],
}


def made_up(seed, n=25, turns=8):
    rng = random.Random(seed)
    return [(f"c{c}", t, {f: rng.choice(words) for f, words in WORDS.items() if rng.random() < 0.6}) for c in range(n) for t in range(rng.randint(1, turns))]


def run(spark, folder, batches):
    """Each batch lands, and a new stream goes on from the checkpoint of the one before."""
    for rows in batches:
        spark.createDataFrame(rows, UPDATES).repartition(2).write.mode("append").parquet(f"{folder}/in")
        stream = profiles.profile_stream(landing.landing(spark, f"{folder}/in", UPDATES))
        profiles.start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()


@pytest.mark.parametrize("cuts", [[8], [1, 3, 8]])
def test_profiles(spark, tmp_path, cuts):
    rows = made_up(len(cuts))
    batches = [[r for r in rows if a <= r[1] < b] for a, b in zip([0, *cuts], cuts, strict=False)]
    run(spark, str(tmp_path), batches)
    want = rules.fold_profiles(spark.createDataFrame(rows, UPDATES))
    got = profiles.last_profiles(spark, f"{tmp_path}/out").drop("turn")
    fields = ["conversation_id", *V.PROFILE_FIELDS, "questions"]
    assert sorted(map(repr, got.select(fields).collect())) == sorted(map(repr, want.select(fields).collect()))
    every = spark.read.parquet(f"{tmp_path}/out")
    assert every.count() == len(rows) and every.where("size(questions) > 0").count() > 0


def test_late_turns_change_nothing(spark, tmp_path):
    run(spark, str(tmp_path), [[("c", 2, {"capacity": "2 L"})], [("c", 1, {"capacity": "1 L", "product_type": "x"}), ("c", 3, {"product_type": "y"}), (None, None, {"capacity": "0 L"})]])
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.conversation_id, r.turn, r.kind, r.capacity, r.product_type) for r in rows} == {
        ("c", 2, "turn", "2 L", None), ("c", 1, "late", "2 L", None), ("c", 3, "turn", "2 L", "y"), (None, None, "turn", "0 L", None),
    }


def test_idle_conversations_are_closed(spark, tmp_path):
    land = lambda rows: spark.createDataFrame(rows, UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = lambda: {(r.conversation_id, r.turn, r.kind, r.capacity) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    land([("c", 1, {"capacity": "1 L"})])
    stream = profiles.profile_stream(landing.landing(spark, f"{tmp_path}/in", UPDATES), idle=0.2)
    query = profiles.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "300 milliseconds")
    try:
        seen, end = set(), time.time() + 40
        for awaited in [("c", 1, "closed", "1 L"), ("c", 1, "turn", "3 L")]:
            while awaited not in seen and time.time() < end:
                time.sleep(1)
                with contextlib.suppress(AnalysisException):  # a batch is being written
                    seen = rows()
            assert awaited in seen
            land([("c", 1, {"capacity": "3 L"})])  # anew: not late
    finally:
        query.stop()


UPLOADS = "id long, content string"


def first_come(batches):
    known, out = {}, set()
    for batch in batches:
        for i, content in sorted(batch):
            out.add((i, known.setdefault(content, i), "new" if known[content] == i else "duplicate"))
    return out


def test_intake(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(100 * b + i, rng.choice(["x", "y", None, "", f"own {i}", f"t{rng.randrange(20)}"])) for i in range(40)] for b in range(3)]
    folder = str(tmp_path)
    done = lambda: {(r.id, r.of, r.outcome) for r in spark.read.parquet(f"{folder}/outcomes").collect()}
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, UPLOADS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        intake.start(landing.landing(spark, f"{folder}/in", UPLOADS, 1), folder, "content", "id").awaitTermination()
        assert done() == first_come(batches[: b + 1])
    # a batch that is done again leaves what it left, even when later ones are there
    again = intake.intake(folder, "content", "id")
    for b in (1, 0, 2):
        again(spark.createDataFrame(batches[b], UPLOADS), b)
        assert done() == first_come(batches)
    again(spark.createDataFrame([], UPLOADS), 3)
    assert done() == first_come(batches)


def test_turns_of_a_batch_read_and_write_the_state_once():
    class State:
        asked, told, exists = 0, [], None  # that it exists is not asked apart

        def get(self):
            self.asked += 1

        def update(self, value):
            self.told.append(value)

    means = [f"{f}_{m}" for f in profiles.MEANINGS for m in ("means", "meant")]
    columns = ["conversation_id", "turn", "entries", "capacity", "product_category", "intended_use", "product_type", *means, "heater_type"]
    profile = profiles.Profile(columns, columns[3:7], None)
    profile.state, profile.names = State(), [*columns[3:7], *(f"{f}_means" for f in profiles.MEANINGS)]
    rows = iter([(7, turn, "", f"{turn} L", *[None] * 8) for turn in (2, 1, 3, 1)])
    out = list(profile.handleInputRows((7,), rows, None))
    assert [(r.turn, r.capacity, r.kind) for r in out] == [(1, "1 L", "turn"), (1, "1 L", "turn"), (2, "1 L", "turn"), (3, "1 L", "turn")]
    assert profile.state.asked == 1 and [x[:2] for x in profile.state.told] == [(3, "1 L")]
