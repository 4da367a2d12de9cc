"""Exact arithmetic on vectors of whole numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are cut off at this size, so that squares and products of many dimensions fit 64 bits.
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, x as double."""
    limit = float(LARGEST)
    return F.transform(vector, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x * F.lit(float(factor))).cast("double"))).cast("int"))


def rows_of(cells, dim: int, kind) -> np.ndarray:
    """The vectors of a column of binaries as rows of one matrix."""
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b (whole numbers), exact."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:  # sums of whole numbers below 2^53 are exact in doubles, in any order
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
