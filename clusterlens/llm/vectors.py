"""Embedding columns as integer matrices.

A vector is *usable* when it is not null, has the table's dimension (the
longest vector's) and holds finite numbers only: a vector that is too short
lacks entries, which count as null. ``matrices`` turns the usable rows of a
batch into an integer matrix floor(scale * entry); entries must stay below
``LIMIT`` after scaling, so that squares of sums over a row fit 64 bits
(a larger one is an error: it is neither dropped nor clipped).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
LIMIT = 1 << 27


def dimension(vectors: DataFrame, col: str) -> int:
    """Entries of the longest vector; 0 when there is none."""
    return vectors.agg(F.max(F.size(F.col(f"`{col}`")))).first()[0] or 0


def usable(col: str, dim: int) -> Column:
    """Whether the vector has ``dim`` entries, all of them finite."""
    finite = F.forall(F.col(f"`{col}`"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(f"`{col}`").isNotNull() & (F.size(F.col(f"`{col}`")) == dim) & F.lit(dim > 0) & finite


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) of a list column of usable vectors, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a vector entry reaches {LIMIT // SCALE}")
    return scaled.astype(np.int64).reshape(-1, dim)
