"""Column expressions that the native operators share: no Python runs for them on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chars(text: Column) -> Column:
    """The text's characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def running(lengths: Column) -> Column:
    """For each element the sum of those before it; by blocks, so that long arrays don't take quadratic time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def inner(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        firsts = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b)))
        within = lambda f: F.transform(
            v,
            lambda _, i: F.get(f, F.floor(i / BLOCK).cast("int")) + total(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        )
        return let(sums, lambda s: let(firsts(s), within))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, inner))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points), match (of the group) of all leftmost non-overlapping matches."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))

    def place(v: Column) -> Column:
        steps = F.zip_with(v["gaps"], v["whole"], lambda g, m: F.length(g) + F.length(m))

        def spans(starts: Column) -> Column:
            rows = F.arrays_zip(starts.alias("at"), v["gaps"].alias("gap"), v["whole"].alias("whole"), v["part"].alias("part"))
            start = lambda x: x["at"] + F.length(x["gap"])
            return F.transform(rows, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["whole"])).alias("end"), x["part"].alias("match")))

        return let(running(steps), spans)

    parts = F.split(text, pattern, -1)
    whole = F.struct(found(0).alias("whole"), found(group).alias("part"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), let(whole, place)).otherwise(none)
