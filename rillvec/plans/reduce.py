"""Sums of arrays that tasks emit, added up on executors.

A task emits one row a key: its sum as the bytes of float64 numbers.  Rows are
grouped by key, so many keys a group that one task adds at most ``SHARE`` bytes
to it; what reaches the driver is one row a key, however many tasks there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that one task adds to a group; 100,000 tasks make groups of 400 MB at most.
SHARE = 4096
PARTIAL = "key int, task int, total binary"


def partial(total: np.ndarray) -> pa.RecordBatch:
    """A task's rows: one for each key whose row of ``total`` is not all zero."""
    some = np.flatnonzero(total.any(axis=1))
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), task, np.int32)), pa.array([row.tobytes() for row in np.ascontiguousarray(total[some], dtype=np.float64)], pa.binary())], names=["key", "task", "total"])


def _add(key: tuple, table: pa.Table) -> pa.Table:
    keys, tasks = table.column("key").to_numpy(), table.column("task").to_numpy()
    x = np.frombuffer(b"".join(table.column("total").to_pylist())).reshape(len(keys), -1)
    order = np.lexsort((tasks, keys))  # a fixed order of addition: reruns agree to the last bit
    some, first = np.unique(keys[order], return_index=True)
    out = np.add.reduceat(x[order], first, axis=0)
    return pa.table({"key": pa.array(some, pa.int32()), "total": pa.array([row.tobytes() for row in out], pa.binary())})


def summed(parts: DataFrame, keys: int, width: int) -> DataFrame:
    """key, total of rows as in ``PARTIAL``: at most ``keys`` rows."""
    groups = max(1, -(-keys * width * 8 // SHARE))
    return parts.groupBy(F.pmod("key", F.lit(groups)).alias("g")).applyInArrow(_add, "key int, total binary")


def collect_sums(parts: DataFrame, keys: int, width: int) -> np.ndarray:
    """The same as a (keys, width) matrix on the driver."""
    out = np.zeros((keys, width))
    for row in summed(parts, keys, width).collect():
        out[row["key"]] = np.frombuffer(row["total"])
    return out
