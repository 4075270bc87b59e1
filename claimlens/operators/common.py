"""Small shared helpers: size-checked broadcasts, Arrow batches in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024

#: Tokens that a NumPy kernel works on at once: its arrays don't grow with Spark's batches.
PIECE = 1 << 16


def pieces(batch: pa.RecordBatch, size: np.ndarray, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of rows that hold ``most`` tokens together (``size`` of each row); a row of more comes alone."""
    upto, at = np.cumsum(size), 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate (for a file scan: the file bytes after pruning)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise a normal shuffled join."""
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def broadcast_counted(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only if the rows, counted by a job, of ``row_bytes`` each are under the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
