"""Counters in hash cells, filled by the tasks of one pass and added up by cell range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells sent as one row.
CELLS = 1 << 16
SCHEMA = "part int, body binary"


def width_for(size: int, least: int, most: int) -> int:
    """The power of two at or above ``size``, within two others."""
    return min(most, max(least, 1 << max(0, size - 1).bit_length()))


def add(sketch: np.ndarray, at: np.ndarray, n: np.ndarray | None = None) -> None:
    """Adds ``n`` (or ones) to the cells ``at``; a cell stops at the greatest number of its type."""
    u, inverse = np.unique(at, return_inverse=True)
    total = np.bincount(inverse, weights=n, minlength=len(u))
    sketch[u] = np.minimum(sketch[u] + total, np.iinfo(sketch.dtype).max).astype(sketch.dtype)


def merged(rows: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], cells: int, kind: type, tasks: int) -> np.ndarray:
    """The sum of what ``fill(batches, sketch)`` counts in each task, on the driver: ``cells`` numbers of type ``kind``.

    At most ``tasks`` tasks read ``rows``, as each sends a sketch; callers derive
    them from ``defaultParallelism``, so where executors come and go,
    ``spark.default.parallelism`` should name the cores of the whole cluster.
    Ranges of cells are added up by the executors.  ``cells`` is a multiple of ``CELLS``.
    """
    most = np.iinfo(kind).max

    def count(batches):
        sketch = np.zeros(cells, kind)
        fill(batches, sketch)
        body = sketch.reshape(-1, CELLS)
        for i in np.flatnonzero(body.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([body[i].tobytes()])], names=["part", "body"])

    def total(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = parts.setdefault(i, np.zeros(CELLS, np.uint32))
                np.minimum(have + np.frombuffer(body.as_buffer(), kind), most, out=have)
        for i, have in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([have.astype(kind).tobytes()])], names=["part", "body"])

    out = np.zeros((cells // CELLS, CELLS), kind)
    for row in rows.coalesce(max(1, tasks)).mapInArrow(count, SCHEMA).repartition("part").mapInArrow(total, SCHEMA).toLocalIterator():
        out[row["part"]] = np.frombuffer(row["body"], kind)
    return out.ravel()
