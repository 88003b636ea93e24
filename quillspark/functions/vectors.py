"""Vector functions: accumulated in double, evaluated inside Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_QUERY, OTHER_DIMENSION = "the query is a zero vector", "the query has another dimension than a candidate"


def dot(a: Column, b: Column) -> Column:
    """Null where the sizes differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def squared_norm(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """Brought to length one; null for a zero vector."""
    both = F.array(F.struct(a.alias("v"), F.sqrt(squared_norm(a)).alias("norm")))  # the vector and its length once a row, not once an element
    return F.get(F.transform(both, lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x / s["norm"]))), F.lit(0))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """norms: squared, where they are at hand. A zero vector has no cosine."""
    scale = (squared_norm(a) if a_norm is None else a_norm) * (squared_norm(b) if b_norm is None else b_norm)
    return F.when(scale > 0, dot(a, b) / F.sqrt(scale))


def checked_cosine(a: Column, query: Column, a_norm: Column, query_norm: Column) -> Column:
    """cosine, where a zero query and a query of another dimension are errors."""
    error = lambda why: F.raise_error(F.lit(why)).cast("double")
    wrong = F.when(query_norm == 0, error(ZERO_QUERY)).when(F.size(a) != F.size(query), error(OTHER_DIMENSION))
    return F.coalesce(wrong, cosine(a, query, a_norm, query_norm))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of doubles; others are an error."""
    rows = vectors.combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    if len(rows) and (sizes != sizes[0]).any():
        raise ValueError(OTHER_DIMENSION)
    return rows.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def to_text(a: Column) -> Column:
    return F.to_json(a)


def from_text(text: Column) -> Column:
    """Damaged text is an error, not a missing vector."""
    got = F.from_json(text, "array<float>")
    return F.when(text.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.lit("not a vector")).cast("array<float>"))
