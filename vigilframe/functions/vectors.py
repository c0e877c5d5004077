"""Vector expressions, and a deterministic embedder for use without model weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from vigilframe.config import EMBEDDING_DIM


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine_to_unit(query: Column, unit: Column) -> Column:
    """Cosine of a query with a unit row; 0 for a zero query."""
    return F.coalesce(F.try_divide(dot(query, unit), norm(query)), F.lit(0.0))


def hashed_vector(text: str, dim: int = EMBEDDING_DIM) -> np.ndarray:
    """FNV-1a of the UTF-16 units seeds an xorshift generator of numbers in [-1, 1). Not normalised."""
    state = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist():
        state = ((state ^ unit) * 0x01000193) & 0xFFFFFFFF
    state = state or 1
    out = np.empty(dim, np.float32)
    for i in range(dim):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        out[i] = state / 0x100000000 * 2 - 1
    return out


@pandas_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashed_vector(t or ""))


@pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def float_rows(content: pd.Series, dim: pd.Series) -> pd.Series:
    """Row-major little-endian float32 bytes as rows; fails unless the length is a multiple of the row's."""
    out = []
    for raw, d in zip(content, dim, strict=True):
        if len(raw) % (4 * d):
            raise ValueError(f"{len(raw)} bytes are no whole rows of {d} floats")
        out.append(np.frombuffer(raw, "<f4").reshape(-1, d).tolist())
    return pd.Series(out)
