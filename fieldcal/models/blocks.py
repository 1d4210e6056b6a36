"""Sums of equally shaped number blocks that tasks make, added up by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "f int, m binary"
_PARTS = 64


def block_rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows f, m of a task's blocks."""
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["f", "m"])


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for table in tables:
        for part in table.column("m"):
            total = total + np.frombuffer(part.as_buffer())
    yield block_rows({key[0].as_py(): total})


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the blocks ``m`` of each ``f``, in two steps, so that no task adds the blocks of all tasks."""
    salted = parts.withColumn("part", F.pmod(F.shiftright(F.monotonically_increasing_id(), 33), F.lit(_PARTS)))
    halfway = salted.groupBy("f", "part").applyInArrow(_add, SCHEMA)
    return {r["f"]: np.frombuffer(r["m"]) for r in halfway.groupBy("f").applyInArrow(_add, SCHEMA).collect()}  # one row for each f
