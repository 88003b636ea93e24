"""Fill-in-middle: a text's middle goes behind its prefix and suffix, so that a left-to-right model learns to fill gaps.

A text is cut between units (white space and the word after it; white space that ends the text is a unit of its own). Its unit
ends are a bit vector over its UTF-8 bytes, packed into 64-bit words under a directory of the ones before each block
of words. The total of ones is the number of units; select on the two ranks that were drawn gives the byte cuts. A
bit a byte is held, and a fixed piece of the text at a time while it is set. Only the cuts come from Python; all
strings are cut and joined by Spark's own functions.

What is drawn depends on the seed and the id alone, so reruns, retries and repeated rows agree.

Defined results: a null text counts as empty, and an empty text is plain; a null id draws as an empty one; texts that
hold one of the marks are plain, so that every output can be taken apart again; an empty table gives an empty table;
extra columns stay, and a taken name gets underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits to an entry of the directory; bytes of text whose bits are made at once (a multiple of 64).
BLOCK, PIECE = 8, 1 << 20


class UnitEnds:
    """Rank and select over the bytes after which a unit ends."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        packed = np.zeros(-(-len(raw) // 64) * 8, np.uint8)
        for at in range(0, len(raw), PIECE):
            part = raw[at : at + PIECE + 1]  # with the byte that follows
            space = (part == 32) | ((part >= 9) & (part <= 13))
            ends = ~space[:PIECE]
            ends[: len(space) - 1] &= space[1 : len(ends) + 1]
            if at + PIECE >= len(raw):
                ends[-1] = True
            bits = np.packbits(ends, bitorder="little")
            packed[at // 8 : at // 8 + len(bits)] = bits
        self.words = packed.view("<u8")
        self.counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.counts, np.arange(0, len(self.words), BLOCK), dtype=np.int64))]) if len(raw) else np.zeros(1, np.int64)

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The bytes that the first k units take."""
        if k == 0:
            return 0
        block = int(np.searchsorted(self.before, k)) - 1
        k -= int(self.before[block])
        sums = np.cumsum(self.counts[block * BLOCK : (block + 1) * BLOCK], dtype=np.int64)
        inner = int(np.searchsorted(sums, k))
        k -= int(sums[inner - 1]) if inner else 0
        word = block * BLOCK + inner
        ones = np.flatnonzero(np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little"))
        return word * 64 + int(ones[k - 1]) + 1


def unit_cuts(text: Column, first: Column, second: Column) -> Column:
    """A struct: n (units), low and high (the bytes before the cuts at the units first % (n + 1) and second % (n + 1), in order)."""

    @F.arrow_udf("struct<n:bigint,low:bigint,high:bigint>")
    def find(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        rows = []
        for x, p, q in zip(texts, ones, twos, strict=True):
            ends = UnitEnds(x.as_py())
            n = ends.total
            low, high = sorted((p.as_py() % (n + 1), q.as_py() % (n + 1)))
            rows.append((n, ends.select(low), ends.select(high)))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["n", "low", "high"])

    return find(text_bytes(text), first, second)


def drawn(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th number (from 0 to 7) that an id draws: 32 bits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, into: str = "infill") -> DataFrame:
    """docs with a new struct column: n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    percent of the texts are transformed, and spm_percent of those put the suffix first.
    """
    into, cuts, form = fresh(docs, into), fresh(docs, "infill_cuts"), fresh(docs, "infill_form")
    whole, own = F.coalesce(F.col(text), F.lit("")), F.col(doc_id)
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (drawn(own, seed, 2) % 100 >= percent)
    rows = docs.withColumn(cuts, unit_cuts(F.col(text), drawn(own, seed, 0), drawn(own, seed, 1)))
    rows = rows.withColumn(form, F.when(plain, "plain").when(drawn(own, seed, 3) % 100 < spm_percent, "spm").otherwise("psm"))
    at = F.col(cuts)
    part = lambda start, end: F.substring(text_bytes(F.col(text)), (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    size = F.length(text_bytes(F.col(text)))
    prefix, middle, suffix = part(F.lit(0), at["low"]), part(at["low"], at["high"]), part(at["high"], size)
    output = F.when(F.col(form) == "plain", whole).when(
        F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    ).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    chars = lambda piece: F.when(F.col(form) != "plain", F.length(piece).cast("long"))
    made = F.struct(
        at["n"].alias("n"), F.col(form).alias("form"), chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output")
    )
    return rows.withColumn(into, made).drop(cuts, form)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    first = F.when(form == "spm", F.locate(PREFIX, output)).otherwise(F.locate(SUFFIX, output))
    last = F.locate(MIDDLE, output)
    one, two, middle = F.substring(output, F.lit(4), first - 4), F.substring(output, first + 3, last - first - 3), F.substring(output, last + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op13(docs: DataFrame) -> DataFrame:
    rows = fill_in_middle(docs.select("doc_id", "text"), into="f").select("doc_id", "f.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
