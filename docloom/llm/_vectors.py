"""Rows of numeric vectors as matrices inside tasks, and sums of small matrices over all tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import frugal, gathered

#: Rows that a task looks at together.
ROWS = 4_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds numbers alone: no null, no NaN, no infinity."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == math.inf))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of lists of ``length`` numbers as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``size`` doubles that ``add`` makes of a batch.

    A task adds its batches up and gives ``size`` rows; these meet by place, so no task and no message holds the numbers
    of many tasks, and the driver gets ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in gathered(batches, ROWS):
            part = add(b)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    found = rows.mapInArrow(frugal(run), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out
