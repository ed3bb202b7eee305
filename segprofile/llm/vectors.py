"""Adding up long vectors that tasks have counted, piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: What tasks emit: a piece's number and its 64-bit floats.
PIECE_SCHEMA = "piece int, numbers binary"


def piece_rows(vector: np.ndarray, length: int) -> pa.RecordBatch:
    """A flat vector as rows of ``length`` numbers; pieces of zeros are left out."""
    parts = [(i // length, vector[i : i + length]) for i in range(0, len(vector), length)]
    parts = [(i, p.astype("<f8").tobytes()) for i, p in parts if p.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["piece", "numbers"]
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            numbers = np.frombuffer(numbers.as_buffer(), "<f8")
            if piece in sums:
                sums[piece] += numbers
            else:
                sums[piece] = numbers.copy()
    names = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), pa.array([sums[i].tobytes() for i in names], pa.binary())], ["piece", "numbers"]
    )


def added(pieces: DataFrame, size: int, length: int) -> np.ndarray:
    """The sum of all tasks' vectors: a reducer holds its pieces only, rows stream through it."""
    out = np.zeros(size)
    got = pieces.repartition("piece").mapInArrow(_add, PIECE_SCHEMA).toArrow()
    for piece, numbers in zip(got.column("piece").to_pylist(), got.column("numbers").to_pylist(), strict=True):
        numbers = np.frombuffer(numbers, "<f8")
        out[piece * length : piece * length + len(numbers)] = numbers
    return out
