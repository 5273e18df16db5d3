"""Vectors as exact integers: which rows take part, and arithmetic that never rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this magnitude sums of a few thousand products of two components are exact in doubles, and in 64-bit integers.
EXACT = 1 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities; true for an empty one."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: DataFrame, by: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(by * x) of each component x, as doubles, of the rows whose vectors are finite before and after."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    down = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger ones are whole
    return rows.select("vec_id", F.transform("v", lambda x: down(x * float(by))).alias("v")).where(finite(F.col("v")))


def flat(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, all of `dim` components, as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles without fractions as integers: of 64 bits where products are exact in them, else Python's own."""
    if not values.size or np.abs(values).max() < EXACT:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole doubles, exactly; as doubles where those hold them, else as Python's integers."""
    most = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    return a @ b.T if most[0] * most[1] * a.shape[1] < 1 << 53 else whole(a).astype(object) @ whole(b).astype(object).T
