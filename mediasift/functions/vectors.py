"""Vector expressions: dot product, norm, normalisation, and the binary form of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in index order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(v: Column) -> Column:
    """The vector over its norm; null for a zero vector. The norm is found once, by the fold."""
    return F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda square: F.when(square > 0, F.transform(v, lambda x: x.cast("double") / F.sqrt(square))),
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(raw: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats to an array; null stays null."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def vector_to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())
