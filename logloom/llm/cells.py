"""Sums of fixed-size arrays over all tasks.

A task adds to an array of its own and returns it in chunks; the chunks are summed by
range, each in a stream, and only the total, of the same fixed size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14
CELLS = "chunk int, cells binary"


def chunks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The chunks of a flat array that are not all zero."""
    for i in range(0, len(cells), CHUNK):
        part = cells[i : i + CHUNK]
        if part.any():
            yield i // CHUNK, part.tobytes()


def chunk_batches(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in chunks(cells):
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["chunk", "cells"]
        )


def total(parts: DataFrame, size: int, dtype: str, wide: str) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` cells; summed and returned as ``wide``."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(cells, dtype).astype(wide)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                ["chunk", "cells"],
            )

    n = -(-size // CHUNK)
    out = np.zeros(size, wide)
    for row in parts.repartition(n, "chunk").mapInArrow(run, CELLS).collect():
        part = np.frombuffer(row["cells"], wide)
        at = row["chunk"] * CHUNK
        out[at : at + len(part)] = part
    return out
