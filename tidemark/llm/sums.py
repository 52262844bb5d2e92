"""Sums of fixed size over vector columns: tasks reduce their rows, Spark adds up what they made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces

# Sums of products below this are exact in doubles.
EXACT = 1 << 53


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def column_sums(rows: np.ndarray) -> np.ndarray:
    """Exact column sums of an integer matrix, as Python integers."""
    most = int(np.abs(rows).max(initial=0))
    wide = rows if most * max(len(rows), 1) < 1 << 62 else rows.astype(object)
    return wide.sum(axis=0).astype(object)


def products(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns of an integer matrix, as Python integers."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * max(len(rows), 1) < EXACT:
        wide = rows.astype(float)
        return (wide.T @ wide).astype(np.int64).astype(object)
    if most * most * 8 < EXACT:
        half = len(rows) // 2
        return products(rows[:half]) + products(rows[half:])
    wide = rows.astype(object)
    return wide.T @ wide


def summed(
    frame: DataFrame, make: Callable[[list[pa.Array]], np.ndarray], cells: int, exact: bool = True
) -> list:
    """The sum of what ``make`` returns for pieces of the columns of ``frame``, cell by cell.

    ``make`` gets the columns of a piece of bounded size and returns ``cells`` numbers: integers,
    added exactly, or doubles with ``exact=False``. A task sends one row per cell, and only the
    ``cells`` totals reach the driver.
    """
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for piece in pieces(batch, batch.schema.names, 8 << 20):
                made = make(piece.columns)
                total = made if total is None else total + made
        made = [] if total is None else [Decimal(int(x)) if exact else float(x) for x in total]
        yield pa.record_batch({"cell": pa.array(range(len(made)), pa.int32()), "s": pa.array(made, kind)})

    rows = frame.mapInArrow(run, f"cell int, s {'decimal(38,0)' if exact else 'double'}")
    totals = [0] * cells
    for cell, s in rows.groupBy("cell").agg(F.sum("s")).collect():
        totals[cell] = int(s) if exact else s
    return totals
