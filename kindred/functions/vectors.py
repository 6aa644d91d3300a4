"""Vector functions. Sums run in order in float64, so results are the same on every plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import once

_ZERO = 0.0


def square_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(_ZERO), lambda a, x: a + x.cast("double") * x.cast("double"))


def is_valid(v: Column, dim: int | Column | None = None) -> Column:
    """True for a vector that can be normalised: not null or empty, finite, non-zero, of `dim` elements."""
    return once(square_sum(v), lambda total: _usable(v, total, dim))


def _usable(v: Column, total: Column, dim: int | Column | None) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size(v) > 0) & finite & (total > 0) & (total < float("inf"))
    if dim is not None:
        good = good & (F.size(v) == dim)
    return F.coalesce(good, F.lit(False))


def l2_normalize(v: Column, dim: int | Column | None = None) -> Column:
    """Elements divided by the float64 norm and rounded to float32; null when is_valid() is false."""
    scaled = lambda norm: F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
    return once(square_sum(v), lambda total: F.when(_usable(v, total, dim), once(F.sqrt(total), scaled)))


def dot(a: Column, b: Column) -> Column:
    """Float64 inner product; null where sizes differ or a side is null or empty."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(products, F.lit(_ZERO), lambda s, z: s + z))


@F.pandas_udf(T.BinaryType())
def encode(v: pd.Series) -> pd.Series:
    """float32 elements as little-endian bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(data: pd.Series, dim: pd.Series) -> pd.Series:
    """Little-endian bytes as float32 elements; null unless there are exactly 4 * dim bytes and dim > 0."""
    return pd.Series([
        np.frombuffer(b, dtype="<f4") if b is not None and d == d and d is not None and d > 0 and len(b) == 4 * d else None
        for b, d in zip(data, dim)
    ])
