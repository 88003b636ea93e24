"""Conversation structure repair: the cheapest edits that turn a conversation into an optional system row and user/assistant pairs.

A conversation's rows, in the order of turn (nulls first), role and text, become a signature: a letter a row that says its role's
initial and its fault. Signatures go, sorted, into a prefix trie. A node holds one layer of the dynamic programme: for
each state of the wanted pattern the least cost so far, the place of its edits among those of the other states in ASCII order, and
the way back. A layer is computed once for all conversations that share the prefix, and where a signature ends its
node gives the answer. Edits of two states never are prefixes of each other at the end of a row (each holds a letter for
every row), so comparing places and then letters is comparing the whole texts.

Rows are shuffled once, by conversation; a task holds the conversations of one batch and a trie of bounded size. A
conversation of more than `MOST_ROWS` rows and 1/100,000 of all rows isn't gathered: its rows are sorted over many tasks, cut
into blocks of `BLOCK_ROWS`, and each block goes through the tries of all four states that it can be entered in. What a
block does is then a few numbers; a chain over those picks states, the blocks are edited where they are, and only
edited text, which the digest must read in order, streams through one task.

Faults: blank (no character that isn't white space), duplicate (role and text seen earlier in the conversation), truncated (the
last such character isn't one of `.!?`); the first that holds counts. Edits: K keep, R rerole to user or assistant (1), D delete
(2; blank and duplicate rows must go), I insert an empty user or assistant row (5); a truncated row that stays costs 5 more.

Defined results: a null role or text is one space; rows of equal turn are ordered by role and text, bytewise; rows that agree
in everything are duplicates of the first; a null conv_id is a conversation of its own; a role counts by its first character, which is
its own where it is none of s, u and a; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import HOT_SHARE, SPACES, cut, join_counted, stored

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States of the pattern: nothing yet, after system, after user, after assistant; those it may end in; where an inserted or reroled row leads.
STATES, ENDS, NEXT = range(4), (0, 3), (2, 2, 3, 2)
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = "su", "ua", "au"
#: The roles of the rows inserted at the end, of one row or two.
LAST_ROLES = "user", "assistant"
#: Rows from which a conversation may be cut into blocks; rows of a block; rows and bytes of a batch; nodes of a trie, which then starts anew.
MOST_ROWS, BLOCK_ROWS, BATCH_ROWS, BATCH_BYTES, MOST_NODES = 20_000, 1_024, 8_192, 16 << 20, 200_000
LAST = (1 << 31) - 1

#: A layer: for each state (cost above the least, place), or None. Ways back: for each state (state before, letters), or None.
Layer = tuple[tuple[int, int] | None, ...]
Ways = tuple[tuple[int, str] | None, ...]


def moves(state: int, symbol: str) -> Iterator[tuple[str, int, int]]:
    """The edits of one row: letter, cost, next state. x: it must go; a capital: it is truncated."""
    yield "D", DELETE, state
    if symbol != "x":
        more = CUT_OFF if symbol.isupper() else 0
        if (symbol.lower(), state) in KEEP:
            yield "K", more, KEEP[symbol.lower(), state]
        yield "R", REROLE + more, NEXT[state]


MOVES = {(s, x): tuple(moves(s, x)) for s in STATES for x in "xsuaoSUAO"}


@lru_cache(100_000)
def step(layer: Layer, symbol: str) -> tuple[Layer, Ways, int]:
    """The layer after one more row, its ways back, and how much its least cost grew."""
    found: dict[int, tuple[int, int, str, int]] = {}
    for before in STATES:
        if layer[before] is not None:
            (cost, place), at, letters = layer[before], before, ""
            for _ in range(3):  # rows inserted ahead: a third would lead where the first did
                for letter, price, to in MOVES[at, symbol]:
                    way = (cost + price, place, letters + letter, before)
                    if to not in found or way < found[to]:
                        found[to] = way
                cost, at, letters = cost + INSERT, NEXT[at], letters + "I"
    least = min(way[0] for way in found.values())
    places = {x: i for i, x in enumerate(sorted({way[1:3] for way in found.values()}))}
    rows = [found.get(s) for s in STATES]
    return tuple(w and (w[0] - least, places[w[1:3]]) for w in rows), tuple(w and (w[3], w[2]) for w in rows), least


def closing(layer: Layer) -> tuple[int, int, str, int]:
    """The cheapest end: cost above the layer's least, place, letters of the rows inserted last, state."""
    found = []
    for state in STATES:
        if layer[state] is not None:
            (cost, place), at, letters = layer[state], state, ""
            for _ in range(3):
                if at in ENDS:
                    found.append((cost, place, letters, state))
                cost, at, letters = cost + INSERT, NEXT[at], letters + "I"
    return min(found)


class Trie:
    """Signatures of conversations, or of blocks, that are entered in one state."""

    def __init__(self, entry: int = 0) -> None:
        self.entry = entry
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.parent, self.total = [0], [0]
        self.layer: list[Layer] = [tuple((0, 0) if s == self.entry else None for s in STATES)]
        self.ways: list[Ways] = [(None,) * 4]

    def _child(self, node: int, symbol: str) -> int:
        own = self.children[node]
        if own is None:
            own = self.children[node] = {}
        if symbol not in own:
            layer, ways, grown = step(self.layer[node], symbol)
            own[symbol] = len(self.children)
            self.children.append(None)
            self.parent.append(node)
            self.total.append(self.total[node] + grown)
            self.layer.append(layer)
            self.ways.append(ways)
        return own[symbol]

    def insert(self, signatures: Iterable[str]) -> dict[str, int]:
        """The nodes where signatures end; in sorted order, so that each goes on from what it shares with the one before."""
        if len(self.children) > MOST_NODES:
            self.clear()
        ends, path, last = {}, [0], ""
        for signature in sorted(set(signatures)):
            shared = 0
            for a, b in zip(last, signature, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for symbol in signature[shared:]:
                path.append(self._child(path[-1], symbol))
            ends[signature], last = path[-1], signature
        return ends

    def edits(self, node: int, state: int) -> str:
        """The letters that lead to this state of a node."""
        letters = []
        while node:
            state, own = self.ways[node][state]
            letters.append(own)
            node = self.parent[node]
        return "".join(reversed(letters))

    def answer(self, node: int) -> tuple[int, str]:
        """The least cost of a whole conversation that ends here, and its edits."""
        cost, _, letters, state = closing(self.layer[node])
        return self.total[node] + cost, self.edits(node, state) + letters


class Part:
    """Rows of a conversation, in order: their counts, signature, and the role and text of those that may stay."""

    def __init__(self, conv: object, whole: bool = True) -> None:
        self.conv, self.seen = conv, set() if whole else None
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = self.size = 0
        self.least = self.most = None
        self.first = self.last = ""
        self.symbols: list[str] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, turn: int | None, role: str, text: str, copies: int, late: bool | None = None) -> None:
        """copies of a row; late: whether it was seen before this part (None: the part is the whole conversation)."""
        if turn is not None and turn != self.most:
            self.n_turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[0] if role[:1] in ("s", "u", "a") else "o"
        self.illegal += copies - 1 + (self.last != "" and self.last + initial not in LEGAL)
        self.first, self.last = self.first or initial, initial
        kept = text.rstrip(SPACES)
        if not kept:
            self.blank += copies
            self.symbols.append("x" * copies)
            return
        if self.seen is not None:
            late = (role, text) in self.seen
            self.seen.add((role, text))
        stay = not late
        self.duplicate += copies - stay
        if stay:
            cut_off = kept[-1] not in ".!?"
            self.truncated += cut_off
            self.symbols.append(initial.upper() if cut_off else initial)
            self.rows.append((role, text))
            self.size += len(text)
        self.symbols.append("x" * (copies - stay))

    @property
    def signature(self) -> str:
        return "".join(self.symbols)

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.n_turns


def applied(signature: str, edits: str, rows: Iterable[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str]]:
    """The rows that edits leave of a part that is entered in a state."""
    symbols, rest = iter(signature), iter(rows)
    for letter in edits:
        if letter == "I":
            state = NEXT[state]
            yield ("user" if state == 2 else "assistant"), ""
            continue
        symbol = next(symbols)
        role, text = next(rest) if symbol != "x" else ("", "")
        if letter == "K":
            state = KEEP[symbol.lower(), state]
            yield role, text
        elif letter == "R":
            state = NEXT[state]
            yield ("user" if state == 2 else "assistant"), text


def table_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


def parts(rows: Iterable[tuple]) -> Iterator[Part]:
    """Whole conversations from rows (conv, turn, role, text, copies) in their order; rows without copies only name their conversation."""
    part = None
    for conv, turn, role, text, copies in rows:
        if part is None or conv != part.conv:
            if part is not None:
                yield part
            part = Part(conv)
        if copies:
            part.add(turn, role, text, copies)
    if part is not None:
        yield part


def blocks(rows: Iterable[tuple], block_rows: int) -> Iterator[Part]:
    """Parts of at most block_rows rows from rows (conv, turn, role, text, copies, late) in their order."""
    part = None
    for conv, turn, role, text, copies, late in rows:
        if part is None or conv != part.conv:
            if part is not None:
                yield part
            part, room = Part(conv, False), block_rows
        while copies:
            if not room or part.size > BATCH_BYTES:
                yield part
                part, room = Part(conv, False), block_rows
            some = min(copies, room)
            part.add(turn, role, text, some, late)
            copies, room, late = copies - some, room - some, True
    if part is not None:
        yield part


def batched(found: Iterable[Part]) -> Iterator[list[Part]]:
    out, n, size = [], 0, 0
    for part in found:
        out.append(part)
        n, size = n + len(part.symbols) + 1, size + part.size
        if n >= BATCH_ROWS or size >= BATCH_BYTES:
            yield out
            out, n, size = [], 0, 0
    if out:
        yield out


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = "position bigint, role string, text string"
BLOCK = (
    "part int, seq int, least bigint, most bigint, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "costs array<bigint>, places array<int>, signature string, edits array<string>, rows array<struct<role:string,text:string>>"
)
CHAIN = "part int, seq int, block bigint, entry int, leave int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, more string"
EDITED = "part int, seq int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, lines string"


def record(columns: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    found = zip(*rows, strict=True) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(found, kinds, strict=True)], columns)


class Shape:
    """What a mapInArrow step returns: conv (of the caller's type) and the columns of a schema text."""

    def __init__(self, df: DataFrame, columns: str) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.sql = f"conv {df.schema['conv'].dataType.simpleString()}, {columns}"
        schema = to_arrow_schema(df.sparkSession.createDataFrame([], self.sql).schema)
        self.names, self.kinds = schema.names, schema.types

    def record(self, rows: list[tuple]) -> pa.RecordBatch:
        return record(self.names, self.kinds, rows)


def lines_digest(rows: Iterable[tuple[str, str]]) -> str:
    found = hashlib.sha256()
    for i, (role, text) in enumerate(rows):
        found.update(("\n" if i else "").encode() + f"{role}:{text}".encode())
    return found.hexdigest()


def _prepared(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None, most_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows (conv, turn, role, text, copies) of most conversations, and those of the few that are too long to gather."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    counts = rows.groupBy("conv").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = cut(counts.where(F.col("n") > max(most_rows, HOT_SHARE * total)).select(F.col("conv").alias("hot_conv"), F.lit(True).alias("is_hot")))
    if hot.isEmpty():
        return rows, None
    told = rows.join(F.broadcast(hot), F.col("conv").eqNullSafe(F.col("hot_conv")), "left").drop("hot_conv")
    return told.where("is_hot is null").drop("is_hot"), told.where("is_hot").drop("is_hot")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(conv, BLOCK) of long conversations' blocks, and (conv, CHAIN): how each is entered and left, and a row of totals a conversation."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit("="), c)
    own = F.unhex(F.md5(F.concat(F.coalesce(sized(F.col("conv").cast("string")), F.lit("-")), sized(F.col("role")), F.col("text")).cast("binary")))
    # rows that agree are one row with a count, so a row said a million times is sent once a task
    alike = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("own", own)
    said = F.col("copies") > 0
    firsts = alike.groupBy("own").agg(
        F.min(F.when(said, F.col("turn"))).alias("first_turn"), F.max(said & F.col("turn").isNull()).alias("no_turn"), F.count("*").alias("members")
    )
    late = ~F.col("turn").eqNullSafe(F.when(~F.col("no_turn"), F.col("first_turn")))
    told = stored(join_counted(alike, firsts, ["own"]).select("conv", "turn", "role", "text", "copies", late.alias("late")))
    start = lambda c: F.substring(c, 1, 64)
    ranged = told.repartitionByRange("conv", F.asc_nulls_first("turn"), start("role"), start("text"))
    shape, links = Shape(rows, BLOCK), Shape(rows, CHAIN)

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, part, seq = [Trie(s) for s in STATES], TaskContext.get().partitionId(), 0
        for found in batched(blocks(table_rows(batches), block_rows)):
            ends = [trie.insert(p.signature for p in found) for trie in tries]
            out = []
            for p in found:
                nodes = [(trie, end[p.signature]) for trie, end in zip(tries, ends, strict=True)]
                costs = [cost and trie.total[node] + cost[0] for trie, node in nodes for cost in trie.layer[node]]
                edits = [cost and trie.edits(node, state) for trie, node in nodes for state, cost in enumerate(trie.layer[node])]
                order = {x: i for i, x in enumerate(sorted({x for x in edits if x is not None}))}
                counts = p.least, p.most, p.n_turns, p.blank, p.duplicate, p.truncated, p.illegal, p.first, p.last
                kept = [{"role": role, "text": text} for role, text in p.rows]
                out.append((p.conv, part, seq, *counts, costs, [order.get(x) for x in edits], p.signature, edits, kept))
                seq += 1
            yield shape.record(out)

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in _grouped(table_rows(batches)):
            yield links.record([(conv, *row) for row in chain(group)])

    done = stored(ranged.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").mapInArrow(cut_up, shape.sql))
    slim = [c for c in done.columns if c not in ("signature", "edits", "rows")]
    chains = done.select(slim).repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(chained, links.sql)
    return done, stored(chains)


def _entered(done: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv, part, seq, block, its number, entry, signature, edits, rows) of blocks, with the edits that were chosen."""
    chosen = chains.where("entry is not null").select("part", "seq", "block", "entry", "leave")
    edits = F.get("edits", 4 * F.col("entry") + F.col("leave")).alias("edits")
    return done.join(chosen, ["part", "seq"]).select("conv", "part", "seq", "block", "entry", "signature", edits, "rows")


def _edited(rows: DataFrame, block_rows: int) -> DataFrame:
    """(conv, EDITED) of long conversations' blocks, and a row of totals behind each conversation's blocks."""
    done, chains = _blocks(rows, block_rows)
    shape = Shape(rows, EDITED)

    def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, seq, _, entry, signature, edits, kept in table_rows(batches):
            lines = "\n".join(f"{r}:{t}" for r, t in applied(signature, edits, ((x["role"], x["text"]) for x in kept), entry))
            yield shape.record([(conv, part, seq, *(None,) * 6, edits, lines)])

    totals = chains.where("entry is null").withColumnRenamed("more", "audit").withColumn("lines", F.lit(None).cast("string"))
    return _entered(done, chains).mapInArrow(edited, shape.sql).unionByName(totals.drop("block", "entry", "leave"))


def _grouped(rows: Iterable[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with the same first value, each without it."""
    for conv, group in groupby(rows, lambda r: r[0]):
        yield conv, (r[1:] for r in group)


def chain(found: Iterable[tuple]) -> list[tuple]:
    """CHAIN rows of one conversation from its blocks in order: the states that each is entered and left in, and the totals."""
    layer: dict[int, tuple[int, int]] = {0: (0, 0)}  # cost, place
    names, ways = [], []
    least = most = None
    n_turns, sums, last = 0, [0, 0, 0, 0], ""
    for part, seq, low, high, own_turns, blank, duplicate, truncated, illegal, first, end, costs, places in found:
        if first == "":
            continue  # no row is left
        n_turns += own_turns - (low is not None and low == most)
        least, most = (low if least is None else least), (most if high is None else high)
        joint = last != "" and last + first not in LEGAL
        sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal + joint), strict=True)]
        last = end
        after: dict[int, tuple[int, int, int, int]] = {}
        for entry, (cost, place) in layer.items():
            for leave in STATES:
                if costs[4 * entry + leave] is not None:
                    way = (cost + costs[4 * entry + leave], place, places[4 * entry + leave], entry)
                    if leave not in after or way < after[leave]:
                        after[leave] = way
        order = {x: i for i, x in enumerate(sorted({w[1:3] for w in after.values()}))}
        layer = {s: (w[0], order[w[1:3]]) for s, w in after.items()}
        names.append((part, seq))
        ways.append(bytes(after[s][3] if s in after else 9 for s in STATES))
    cost, _, more, state = closing(tuple(layer.get(s) for s in STATES))
    gaps = 0 if least is None else most - least + 1 - n_turns
    out: list[tuple] = [(LAST, LAST, len(names), None, None, gaps, *sums, cost, more)]
    for i in range(len(names) - 1, -1, -1):
        out.append((*names[i], i, ways[i][state], state, *(None,) * 7))
        state = ways[i][state]
    return out


def repair_report(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
    most_rows: int = MOST_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row a conversation: its id (named conv_id), gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of its repaired lines.

    copies: a column that says how many times a row stands there; rows with 0 only name their conversation.
    """
    rows, long_rows = _prepared(conversations, conv_id, turn, role, text, copies, most_rows)
    shape = Shape(rows, REPORT)

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for found in batched(parts(table_rows(batches))):
            ends = trie.insert(p.signature for p in found)
            answers = {signature: trie.answer(node) for signature, node in ends.items()}
            out = []
            for p in found:
                cost, edits = answers[p.signature]
                digest = lines_digest(applied(p.signature, edits, p.rows))
                out.append((p.conv, p.gaps, p.blank, p.duplicate, p.truncated, p.illegal, cost, edits, digest))
            yield shape.record(out)

    made = _in_order(rows).mapInArrow(report, shape.sql)
    if long_rows is not None:  # only their edited text goes through one task a conversation

        def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for conv, group in _grouped(table_rows(batches)):
                digest, edits, begun = hashlib.sha256(), [], False
                for part, _, gaps, blank, duplicate, truncated, illegal, cost, audit, lines in group:
                    edits.append(audit)
                    if part == LAST:
                        totals, lines = (gaps, blank, duplicate, truncated, illegal, cost), "\n".join(f"{role}:" for role in LAST_ROLES[-len(audit) :] if audit)
                    if lines:
                        digest.update(("\n" if begun else "").encode() + lines.encode())
                        begun = True
                yield shape.record([(conv, *totals, "".join(edits), digest.hexdigest())])

        tails = _edited(long_rows, block_rows).repartition("conv").sortWithinPartitions("conv", "part", "seq")
        made = made.unionByName(tails.mapInArrow(digested, shape.sql))
    return made.withColumnRenamed("conv", conv_id)


def repaired(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
    most_rows: int = MOST_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The repaired conversations' rows: conv_id, position (ascending; between blocks of a long conversation it jumps), role, text."""
    rows, long_rows = _prepared(conversations, conv_id, turn, role, text, copies, most_rows)
    shape = Shape(rows, ROWS)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for found in batched(parts(table_rows(batches))):
            ends = trie.insert(p.signature for p in found)
            for p in found:
                left = applied(p.signature, trie.answer(ends[p.signature])[1], p.rows)
                yield shape.record([(p.conv, i, *row) for i, row in enumerate(left)])

    made = _in_order(rows).mapInArrow(whole, shape.sql)
    if long_rows is not None:
        done, chains = _blocks(long_rows, block_rows)

        def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for conv, _, _, block, entry, signature, edits, kept in table_rows(batches):
                left = applied(signature, edits, ((x["role"], x["text"]) for x in kept), entry)
                yield shape.record([(conv, 4 * block_rows * block + i, *row) for i, row in enumerate(left)])

        n = F.length("more")
        ends = chains.where("entry is null and more != ''").select(
            "conv", "block", F.posexplode(F.when(n == 1, F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))).alias("i", "role")
        )
        ends = ends.select("conv", (4 * block_rows * F.col("block") + F.col("i")).alias("position"), "role", F.lit("").alias("text"))
        made = made.unionByName(_entered(done, chains).mapInArrow(by_block, shape.sql)).unionByName(ends)
    return made.withColumnRenamed("conv", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by the checksum of conv_id and turn; copies: how often a row stands there, 0 for a dropped one."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    copies: Column = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op11(conversations: DataFrame) -> DataFrame:
    return repair_report(damaged(conversations), copies="copies")
