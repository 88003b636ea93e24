"""Conversation repair against a programme over whole texts of edits, all edits tried out, and long conversations in blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import repair

SPACE = "\t\n\x0b\x0c\r "
CONVERSATIONS = "conv_id long, turn long, role string, text string"
WANTED = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out, ids = [], set()
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        ids.add(conv)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out, ids


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.rstrip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, repaired rows): for each state and row the least pair of cost and text of edits."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    layer = {0: (0, "", ())}

    def grown(layer):
        for _ in range(4):
            for state, (cost, edits, left) in list(layer.items()):
                for letter, to in follow[state].items():
                    if letter != "s":
                        new = (cost + 5, edits + "I", (*left, (names[letter], "")))
                        layer[to] = min(layer.get(to, new), new)
        return layer

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for state, (cost, edits, left) in grown(layer).items():
            ways = [(state, cost + 2, edits + "D", left)]
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                ways += [(to, cost, edits + "K", (*left, (role, text))) for i, to in follow[state].items() if role[:1] == i]
                ways += [(to, cost + 1, edits + "R", (*left, (names[i], text))) for i, to in follow[state].items() if i != "s"]
            for to, *way in ways:
                after[to] = min(after.get(to, tuple(way)), tuple(way))
        layer = after
    return min(way for state, way in grown(layer).items() if state in (0, 3))


def all_edits(rows, found):
    """The same by trying everything; for a few rows."""
    best = None
    choices = []
    for _, fault in zip(rows, found, strict=True):
        choices.append([[*pre, e] for n in (0, 1, 2) for pre in itertools.product(("Iu", "Ia"), repeat=n) for e in (("D",) if fault in ("blank", "duplicate") else ("D", "K", "Ru", "Ra"))])
    for ends in ([], ["Ia"], ["Iu", "Ia"]):
        for picked in itertools.product(*choices):
            initials, cost, audit = "", 0, ""
            for (_, role, _), fault, edits in zip(rows, found, picked, strict=True):
                for e in edits:
                    audit += e[0]
                    cost += {"I": 5, "D": 2, "K": 0, "R": 1}[e[0]] + (5 if fault == "truncated" and e[0] in "KR" else 0)
                    initials += e[1:] if e[0] in "IR" else (role[:1] or "?") if e == "K" else ""
            audit, cost, initials = audit + "I" * len(ends), cost + 5 * len(ends), initials + "".join(e[1] for e in ends)
            if WANTED.match(initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def wanted(rows, ids):
    out = set()
    for conv in ids:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        cost, audit, left = cheapest(own, found)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out.add((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def made_up(seed, n=60, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut of", "", " \n", None, "Same. ", "Same.\n", "é", "x.y", "Long " * 30 + "."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "User"]
    rows = []
    for conv in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((None if conv == 7 else conv, rng.choice([t, t, t, t + 3, None, 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"said {rng.random()}."))
    return rows + rows[:5] + rows[:5] + [(None, None, None, None)]


def test_all_edits_tried_out():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", " ", f"{i}."])) for i in range(rng.randint(0, 3))]
        found = faults(rows)
        part = repair.Part(0)
        for row in rows:
            part.add(*row, 1)
        trie = repair.Trie()
        assert trie.answer(trie.insert([part.signature])[part.signature]) == all_edits(rows, found) == cheapest(rows, found)[:2]


def test_layers_are_shared():
    trie = repair.Trie()
    ends = trie.insert(["uaua", "uaux", "ua", "uaua", "s", ""])
    assert len(trie.children) == 1 + 5 + 1 and set(ends) == {"uaua", "uaux", "ua", "s", ""}
    before = len(trie.children)
    trie.insert(["uau", "uauaua"])
    assert len(trie.children) == before + 2


def test_full_trie_starts_anew(monkeypatch):
    monkeypatch.setattr(repair, "MOST_NODES", 3)
    trie = repair.Trie()
    first = trie.answer(trie.insert(["uuaau"])["uuaau"])
    assert trie.answer(trie.insert(["uuaau"])["uuaau"]) == first and len(trie.children) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_version(spark, seed):
    rows = made_up(seed)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    assert set(map(tuple, repair.op11(df).collect())) == wanted(*damage(rows))


@pytest.mark.parametrize("most", [0, 9])
def test_long_conversations(spark, most):
    """Blocks are cut where tasks end and at any row."""
    rng = random.Random(5)
    rows = made_up(3, 12) + [(50, rng.choice([i, None]), rng.choice(["user", "assistant"]), rng.choice([f"t {i}.", "again.", "", "cut"])) for i in range(300)]
    rows += [(51, None, "user", "the same words.")] * 200 + [(52, i % 3, "user", f"{i}.") for i in range(100)] + [(53, i, "system", f"{i}.") for i in range(40)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair_report(repair.damaged(df), copies="copies", most_rows=most, block_rows=7).collect()
        left = repair.repaired(repair.damaged(df), copies="copies", most_rows=most, block_rows=7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = wanted(*damage(rows))
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert_rows(left, want)


def assert_rows(left, want):
    for conv, *_, digest in want:
        lines = [f"{r.role}:{r.text}" for r in sorted((r for r in left if r.conv_id == conv), key=lambda r: r.position)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digest


def test_repaired_rows_have_the_pattern(spark):
    rows = made_up(4)
    left = repair.repaired(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)), copies="copies").collect()
    assert_rows(left, wanted(*damage(rows)))
    for conv in {r.conv_id for r in left}:
        own = sorted((r for r in left if r.conv_id == conv), key=lambda r: r.position)
        assert WANTED.match("".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))


def test_odd_inputs(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.op11(none).count() == 0 and repair.repaired(none).count() == 0
    clash = spark.createDataFrame(made_up(6, 5), CONVERSATIONS)
    for name in ("copies", "conv", "late", "part", "seq", "own", "is_hot", "cost", "audit"):
        clash = clash.withColumn(name, F.lit(3))
    assert set(map(tuple, repair.op11(clash).collect())) == wanted(*damage(made_up(6, 5)))
    texts = spark.createDataFrame([("a", 1, "user", "x. " * 500_000), ("a", 2, "assistant", "y" * 1_000_000 + "!"), (None, None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in repair.repair_report(texts).collect()}
    assert got["a"].audit == "KK" and got[None].audit == "D" and got[None].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_dropped_conversation_stays_in_the_report(spark):
    conv = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.op11(spark.createDataFrame([(conv, 0, "user", "Hello.")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
