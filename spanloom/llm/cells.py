"""Corpus-wide counts in a table of fixed size, summed on the cluster."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .hashing import U, from_planes, pieces, planes

#: Tables summed in one task.
FAN_IN = 256


def cell_of(names: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each 64-bit name in a table of ``1 << bits``."""
    return (names >> U(64 - bits)).astype(np.int64)


def table_row(total: np.ndarray) -> pa.RecordBatch:
    """A task's table as a row ``(task, blob)``."""
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(planes(total), 1)], pa.binary())], ["task", "blob"])


def summed(tables: DataFrame, bits: int) -> np.ndarray:
    """The sum of all tasks' tables ``(task, blob)``, added up in groups of ``FAN_IN``, twice, so that no task and not the driver holds more than a few."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits, dtype=np.int64)
        for blob in table.column("blob"):
            total += from_planes(zlib.decompress(blob.as_py()), np.int64)
        return pa.table({"task": table.column("task").slice(0, 1).cast(pa.int64()), "blob": pa.array([zlib.compress(planes(total), 1)], pa.binary())})

    for _ in range(2):
        tables = tables.selectExpr(f"task div {FAN_IN} as task", "blob").groupBy("task").applyInArrow(lambda t: add(t), "task long, blob binary")
    total = np.zeros(1 << bits, dtype=np.int64)
    for row in tables.toLocalIterator():
        total += from_planes(zlib.decompress(row["blob"]), np.int64)
    return total


def counted(texts: DataFrame, names: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How many of the 64-bit ``names`` of all rows fall in each of ``1 << bits`` cells; a task sends one table whatever it reads."""

    def run(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                total += np.bincount(cell_of(names(piece), bits), minlength=1 << bits)
        yield table_row(total)

    return summed(texts.select("text").mapInArrow(run, "task long, blob binary"), bits)
