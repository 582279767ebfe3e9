"""Vectors as Arrow batches: which take part, equal ones as one, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and some not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def content_key(*parts: Column) -> Column:
    """Names equal vectors (and equal further parts) alike."""
    return F.md5(F.concat_ws(":", *parts))


def written_out(vector: Column) -> Column:
    # adding zero makes -0.0 and 0.0 one text
    return F.array_join(F.transform(vector, lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ",")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
