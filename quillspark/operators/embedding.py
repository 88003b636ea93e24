"""Batch embedding: a model is loaded once a worker and gets texts in batches; its name and dimension go with the vectors.

Any model that maps a list of texts to rows of numbers fits, through a factory that loads it where it runs. Vectors of
different models are never compared: `vector_top_k` and `discovery.retrieve` take the name as a guard.

Defined results: a null text is embedded as an empty one; an empty batch loads nothing; a model that returns another number of
rows or another dimension, or numbers that are not finite, is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[Sequence[str]], np.ndarray]

#: Models of this process, by the embedder they belong to.
_LOADED: dict[str, Encode] = {}


def _model(key: str, factory: Callable[[], Encode]) -> Encode:
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


class Embedder:
    """A function from a text column to a vector column, by a model of this name and dimension that factory loads."""

    def __init__(self, name: str, dimension: int, factory: Callable[[], Encode], batch: int = 256) -> None:
        self.name, self.dimension, self.factory, self.batch = name, dimension, factory, batch
        self.key = f"{name}-{uuid.uuid4().hex}"

    def __call__(self, text: Column) -> Column:
        key, name, dimension, factory, batch = self.key, self.name, self.dimension, self.factory, self.batch

        def embedded(texts: list[str]) -> np.ndarray:
            found = np.asarray(_model(key, factory)(texts), "f4")
            if found.shape != (len(texts), dimension):
                raise ValueError(f"{name} gave {found.shape} for {len(texts)} texts of dimension {dimension}")
            if not np.isfinite(found).all():
                raise ValueError(f"{name} gave numbers that are not finite")
            return found

        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                parts = [embedded(texts.slice(at, batch).to_pylist()) for at in range(0, len(texts), batch)]
                flat = np.concatenate(parts).ravel() if parts else np.empty(0, "f4")
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype="i4") * dimension), pa.array(flat))

        return run(F.coalesce(text, F.lit("")))


def hashed_grams(dimension: int = 384, size: int = 3) -> Callable[[], Encode]:
    """A small model: counts of a text's runs of size characters, in places that a polynomial of their code points gives, brought to length one."""

    def load() -> Encode:
        def encode(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for row, text in zip(out, texts, strict=True):
                points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
                if len(points) >= size:
                    place = np.zeros(len(points) - size + 1, np.int64)
                    for i in range(size):
                        place = (place * 31 + points[i : len(points) - size + 1 + i]) % dimension
                    row += np.bincount(place, minlength=dimension)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.where(norm > 0, norm, 1)

        return encode

    return load


def hashed_gram_embedder(dimension: int = 384, size: int = 3) -> Embedder:
    return Embedder(f"hashed-grams-{size}-{dimension}", dimension, hashed_grams(dimension, size))


def model_name(embed: Callable[[Column], Column]) -> str:
    """An embedder's name; a plain function's own."""
    return getattr(embed, "name", None) or embed.__name__
