"""What the vector operators share: which vectors take part, and each of an id's vectors once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Neither null nor empty, and no component null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def distinct(vectors: DataFrame, usable: Column) -> DataFrame:
    """vec_id, v (array<double>, null where not usable): one row for each id and vector.

    Equal rows count once; different vectors of one id are rows of their own. Rows without an id are left out.
    """
    named = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return named.distinct().select("vec_id", F.when(usable, F.col("embedding")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as rows of `width`; a shorter vector ends in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), kind)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
