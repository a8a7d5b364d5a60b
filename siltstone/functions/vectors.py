"""Vector functions on ``array<float|double>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import small_batches
from .binding import let
from .text import index_terms

# Prefixes the embedding model families were trained with.
E5_QUERY_PREFIX = "query: "
E5_PASSAGE_PREFIX = "passage: "
BGE_QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(vec: Column | str) -> Column:
    return _col(vec).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(vec: Column | str) -> Column:
    """Scale to length one; a zero vector stays zero."""

    def scaled(v: Column, norm: Column) -> Column:
        return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)

    def with_norm(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
        return let(F.sqrt(squares), lambda norm: scaled(v, norm))

    return let(doubles(vec), with_norm)


def term_bucket(term: Column, dim: int) -> Column:
    """Feature-hashing bucket of a term (first eight hex digits of its MD5, modulo ``dim``)."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim).cast("int")


def _unit_counts(dim: int):
    """UDF: arrays of bucket numbers to unit vectors of bucket counts, one batch at a time."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def counts(buckets: pd.Series) -> pd.Series:
        rows = [np.asarray(b if b is not None else [], dtype=np.int64) for b in buckets]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        cells = np.repeat(np.arange(len(rows)), sizes) * dim
        flat = np.concatenate(rows) if rows else np.array([], dtype=np.int64)
        table = np.bincount(cells + flat, minlength=len(rows) * dim).reshape(len(rows), dim).astype(float)
        norms = np.linalg.norm(table, axis=1, keepdims=True)
        return pd.Series(list(table / np.where(norms > 0, norms, 1.0)))

    return counts


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """Model-free default embedding: unit vector of hashed term counts.

    A real model is injected as a ``pandas_udf`` with the same signature
    (text column in, unit ``array<double>`` out).
    """
    small_batches(SparkSession.getActiveSession())
    return _unit_counts(dim)(F.transform(index_terms(text), lambda t: term_bucket(t, dim)))


def prefixed(text: Column | str, model: str, is_query: bool) -> Column:
    """Text with the prefix the model family expects on this side."""
    text = _col(text)
    name = model.lower()
    if "e5" in name:
        return F.concat(F.lit(E5_QUERY_PREFIX if is_query else E5_PASSAGE_PREFIX), text)
    if is_query and "bge" in name and "v1.5" in name:
        return F.concat(F.lit(BGE_QUERY_PREFIX), text)
    return text
