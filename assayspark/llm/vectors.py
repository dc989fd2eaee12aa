"""What the two vector operators share: which vectors take part, and batches of them as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared(v: Column) -> Column:
    """Squared length in double precision."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is there, has only finite components and isn't zero; adds its squared length ``sq``.

    Null, NaN and infinite components all make the sum of squares something else than a finite number.
    """
    out = df.withColumn("sq", squared(F.col(vec)))
    return out.where((F.col("sq") > 0) & (F.col("sq") < F.lit(float("inf"))) & ~F.isnan("sq"))


def stacked(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n) if n else np.zeros((0, 0))
