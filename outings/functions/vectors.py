"""Vector expressions and text embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda total, product: total + product)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a vector has no direction."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


class HashEmbedder:
    """Offline embedder: unit-length counts of the words, each hashed to one of ``dim`` places.

    Words are runs of ASCII letters and digits of the lower-cased text; the place is the first 32 bits of the
    MD5 digest modulo ``dim``. A text without words has the zero vector.
    """

    WORD = re.compile(r"[a-z0-9]+")

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.dim))
        for row, text in zip(counts, texts):
            places = [_word_place(word, self.dim) for word in self.WORD.findall((text or "").lower())]
            np.add.at(row, places, 1.0)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return (counts / np.where(norms == 0, 1.0, norms)).astype(np.float32)


@lru_cache(maxsize=200_000)
def _word_place(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def hash_embedding(text: Column, dim: int) -> Column:
    """What ``HashEmbedder`` gives, as an expression: words, places, counts and norm stay in the JVM and in the row.

    The places of the words are sorted, so the count of a place is the distance from its first position to that of the next.
    The vector is written as the counts with runs of zeros between them.
    """
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def place(word: Column) -> Column:
        return (F.conv(F.left(F.md5(word.cast("binary")), F.lit(8)), 16, 10).cast("long") % dim).cast("int")

    def zeros(count: Column) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), count)

    def vector(distinct: Column, counts: Column, norm: Column) -> Column:
        parts = F.transform(distinct, lambda p, i: F.concat(zeros(p - F.coalesce(F.get(distinct, i - 1), F.lit(-1)) - 1),
                                                            F.array((F.get(counts, i) / norm).cast("float"))))
        return F.concat(F.flatten(parts), zeros(F.lit(dim - 1) - F.coalesce(F.get(distinct, F.size(distinct) - 1), F.lit(-1))))

    def counted(places: Column) -> Column:
        return let(F.array_distinct(places), lambda distinct: let(
            F.transform(distinct, lambda p: F.array_position(places, p).cast("int")), lambda first: let(
                F.transform(first, lambda at, i: (F.coalesce(F.get(first, i + 1), F.size(places) + 1) - at).cast("double")),
                lambda counts: let(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, n: total + n * n)),
                                   lambda norm: vector(distinct, counts, norm)))))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return let(F.sort_array(F.transform(words, place)), counted)


def embed(text: Column | str, embedder: Embedder, batch: int = 100) -> Column:
    """Embed a text column in Arrow batches; the embedder gets at most ``batch`` texts per call. ``HashEmbedder`` becomes an expression.

    Declared as not deterministic, so that Spark does not call it a second time for a filter on its result.
    """
    if type(embedder) is HashEmbedder:
        return hash_embedding(F.col(text) if isinstance(text, str) else text, embedder.dim)

    @F.pandas_udf("array<float>")
    def run(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks:
            vectors = []
            for start in range(0, len(texts), batch):
                vectors.extend(np.asarray(embedder(texts.iloc[start:start + batch].tolist()), dtype=np.float32))
            yield pd.Series(vectors, dtype=object)

    return run.asNondeterministic()(F.col(text) if isinstance(text, str) else text)
