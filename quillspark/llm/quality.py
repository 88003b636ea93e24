"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass to the next. On a sample the
operator measures what a rule costs and how much it rejects, then runs the
rules in the order of rejection per cost. The verdict is the conjunction of all
rules, so the order changes the time and never the result.

Defined results: a null text has no words; an empty table gives an empty table;
repeated rows each get their own verdict; extra columns are kept as they are.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, text_bytes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))


def left(data: bytes, drop: bytes) -> int:
    """How many bytes of data are among drop."""
    return len(data) - len(data.translate(None, drop))


class Doc:
    """A text whose features are computed when a rule first asks for them."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        packed = b"".join(self.words)
        return len(packed) - left(packed, bytes(range(0x80, 0xC0)))

    @cached_property
    def n_symbols(self) -> int:
        return left(self.data, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        hit = bytearray(len(w))
        for i, x in enumerate(windows):
            if counts[x] > 1:
                hit[i : i + 3] = b"\1\1\1"
        return sum(hit)

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_plain_words(self) -> int:
        """Words that hold a letter."""
        return sum(1 for x in self.words if x.translate(None, LETTERS) != x)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def default_rules(
    min_words: int = 50,
    repeat_pct: int = 50,
    symbol_pct: int = 20,
    dup_line_pct: int = 50,
    upper_pct: int = 50,
    plain_pct: int = 60,
    top_word_pct: int = 40,
    mean_chars: tuple[int, int] = (2, 15),
) -> tuple[Rule, ...]:
    """The first two are the base; a limit is a share in percent of the text's words, lines or letters."""
    return (
        Rule("few_words", lambda d: d.n_words < min_words),
        Rule("repeats", lambda d: 100 * d.n_repeat_words > repeat_pct * d.n_words),
        Rule("symbols", lambda d: 100 * d.n_symbols > symbol_pct * d.n_words),
        Rule("dup_lines", lambda d: 100 * d.n_dup_lines > dup_line_pct * len(d.lines)),
        Rule("shouting", lambda d: 100 * left(d.data, UPPER) > upper_pct * left(d.data, LETTERS)),
        Rule("no_letters", lambda d: 100 * d.n_plain_words < plain_pct * d.n_words),
        Rule("top_word", lambda d: 100 * d.top_word > top_word_pct * d.n_words),
        Rule("word_length", lambda d: not mean_chars[0] * d.n_words <= d.word_chars <= mean_chars[1] * d.n_words),
    )


def rule_profile(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[str, float, float]]:
    """(name, seconds a document, share rejected) of each rule alone, on a uniform sample of about sample_rows rows.

    The sample is measured in place on the executors; a few numbers a rule come back.
    """
    n = docs.count()
    share = min(1.0, sample_rows / n) if n else 1.0

    def measure(batches):
        spent, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                seen += 1
                for i, rule in enumerate(rules):
                    doc = Doc(data)
                    began = time.perf_counter()
                    hits[i] += bool(rule.rejects(doc))
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "spent": spent, "hits": hits, "seen": [seen] * len(rules)})

    rows = (
        docs.select(text_bytes(F.col(text)).alias("data"))
        .sample(share, seed)
        .mapInArrow(measure, "rule string, spent double, hits long, seen long")
        .groupBy("rule")
        .agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
        .collect()
    )
    by = {r["rule"]: r for r in rows}
    return [
        (
            x.name, by[x.name]["spent"] / max(1, by[x.name]["seen"]), by[x.name]["hits"] / max(1, by[x.name]["seen"])
        ) if x.name in by else (x.name, 0.0, 0.0) for x in rules
    ]


def cascade_order(profile: Sequence[tuple[str, float, float]]) -> list[str]:
    """Names by rejection per cost, best first."""
    return [name for name, cost, share in sorted(profile, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))]


FEATURES = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"


def cascade(text: Column, rules: Sequence[Rule], order: Sequence[str], features: Sequence[str] = ()) -> Column:
    """A struct: kept, and the features asked for (each long). A rule runs only if all before it passed."""
    by = {r.name: r for r in rules}
    chain = [by[x].rejects for x in order]
    kinds = [("kept", pa.bool_()), *((x, pa.int64()) for x in features)]

    @F.arrow_udf("struct<" + ",".join(f"{k}:{'boolean' if k == 'kept' else 'bigint'}" for k, _ in kinds) + ">")
    def judge(texts: pa.Array) -> pa.Array:
        out = [[] for _ in kinds]
        for x in texts:
            doc = Doc(x.as_py())
            out[0].append(not any(rejects(doc) for rejects in chain))
            for column, name in zip(out[1:], features, strict=True):
                column.append(getattr(doc, name))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds, strict=True)], [k for k, _ in kinds])

    return judge(text_bytes(text))


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, into: str = "quality", features: Sequence[str] = ()) -> DataFrame:
    """docs with a new struct column (named by into, with underscores where that is taken) of the verdict and the features asked for."""
    into = fresh(docs, into)
    rules = default_rules() if rules is None else rules
    order = cascade_order(rule_profile(docs, rules, text))
    return docs.withColumn(into, cascade(F.col(text), rules, order, features))


def quality_report(docs: DataFrame, min_words: int = 50, repeat_pct: int = 50) -> DataFrame:
    """One row a document: its counts, whether the base rules fail it, and the cascade's verdict."""
    rows = quality_filter(docs.select("doc_id", "text"), into="q", features=FEATURES, rules=default_rules(min_words, repeat_pct))
    failed = (F.col("q.n_words") < min_words) | (100 * F.col("q.n_repeat_words") > repeat_pct * F.col("q.n_words"))
    return rows.select("doc_id", *(F.col(f"q.{x}").alias(x) for x in FEATURES), failed.alias("base_failed"), (~failed & F.col("q.kept")).alias("kept"))
