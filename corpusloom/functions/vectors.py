"""Vectors as arrays, in double precision, and the embedders that need no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fnv1a


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """EMB-08; 0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def hash_vector(text: str, dims: int) -> np.ndarray:
    """EMB-02: a signed bucket for each token, of length one."""
    import regex

    out = np.zeros(dims)
    for token in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
        h = fnv1a(token.encode())
        out[h % dims] += -1.0 if h >> 33 & 1 else 1.0
    size = np.sqrt((out**2).sum())
    return out / size if size else out


class HashEmbedder:
    """EMB-01, EMB-02: texts to vectors of a fixed width, known by an identity."""

    def __init__(self, dimensions: int = 384):
        self.dimensions, self.identity = dimensions, f"hash-{dimensions}"

    def embed(self, texts: Column) -> Column:
        dims = self.dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda x: hash_vector(x or "", dims))

        return run(texts)


class ByteSumEmbedder:
    """EMB-03: bytes summed by position modulo the width."""

    def __init__(self, dimensions: int = 16):
        self.dimensions, self.identity = dimensions, f"bytes-{dimensions}"

    def embed(self, texts: Column) -> Column:
        dims = self.dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(batch: pd.Series) -> pd.Series:
            def one(x):
                raw = np.frombuffer((x or "").encode(), np.uint8)
                v = np.bincount(np.arange(len(raw)) % dims, raw, dims)
                size = np.sqrt((v**2).sum())
                return v / size if size else v

            return batch.map(one)

        return run(texts)


def overlap_score(query: str, texts: Column) -> Column:
    """RRK-01: a reranker without a model: the share of the query's tokens that a text has."""
    from .text import query_tokens, tokens

    wanted = sorted({*query_tokens(query)})
    have = tokens(texts)
    return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(have, t))) / float(max(1, len(wanted)))
