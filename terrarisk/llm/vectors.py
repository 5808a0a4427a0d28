"""Embedding columns: the rows that can be computed with, and their batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components are whole numbers of at most this size; larger ones count as this.
LARGEST = 1 << 26


def scaled(df: DataFrame, column: str, factor: int) -> tuple[DataFrame, int]:
    """(df with the vectors' components as floor(factor * component), in x array<long>, and their length).

    Rows whose vector is null, or holds null or non-finite components, go. So do rows of another length than most have
    (of equally frequent lengths the longest; empty vectors never count); the length is 0 where no row is left.
    """
    v = F.col(column)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.filter(v.isNotNull() & (F.size(v) > 0)).filter(whole)
    sizes = kept.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()
    d = sizes.d or 0
    limit = lambda c: F.least(F.greatest(c.cast("double") * factor, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return kept.filter(F.size(v) == d).withColumn("x", F.transform(v, lambda c: F.floor(limit(c)))), d


def matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """A column of arrays of d whole numbers each."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64, copy=False)
