"""Vectors as rows: what both vector operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str = "embedding"):
    """False for vectors that are null, empty or zero, or hold a null, NaN or infinite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column, dtype="float64"):
    """A list column of an Arrow batch, without nulls, as a matrix."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)
