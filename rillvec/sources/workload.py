"""Operation logs: ordered inserts and searches from JSON, and what an insert range means at a given state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument

_OP = "op_id long, operation string, op string, start long, end long, active_rows long, round int, cluster int, source_op_id long"
_SCHEMA = f"dataset string, num_vectors long, dim long, operations array<struct<{', '.join(x.replace(' ', ':') for x in _OP.split(', '))}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """op_id, operation, start, end, active_rows, round, cluster, source_op_id, in order of the file.

    ``operation`` may be called ``op``; ``end`` defaults to ``start``,
    ``active_rows`` to ``end``, ``op_id`` to the place in the file, ``round``
    and ``cluster`` to -1.
    """
    ops = spark.read.schema(_SCHEMA).json(path, multiLine=True).select(F.posexplode("operations").alias("place", "o")).select("place", "o.*")
    start = F.coalesce("start", F.lit(0))
    end = F.coalesce("end", start)
    minus = lambda c: F.coalesce(c, F.lit(-1))
    return ops.select("place", F.coalesce("op_id", F.col("place").cast("long")).alias("op_id"), F.coalesce("operation", "op").alias("operation"), start.alias("start"), end.alias("end"), F.coalesce("active_rows", end).alias("active_rows"), minus("round").alias("round"), minus("cluster").alias("cluster"), F.coalesce("source_op_id", F.lit(-1).cast("long")).alias("source_op_id"))


def check(ops: DataFrame) -> DataFrame:
    """The same operations; raises on one that is neither insert nor search."""
    bad = ops.where("operation is null or operation not in ('insert', 'search')").first()
    if bad is not None:
        raise InvalidArgument(f"unknown operation {bad['operation']} at {bad['place']}")
    return ops


def insert_range(start: int, end: int, seen: int) -> tuple[int, int] | None:
    """The rows of an insert that are new: None if all were seen; a gap is an error, an overlap is cut off."""
    if end <= seen:
        return None
    if start > seen:
        raise InvalidArgument(f"rows {seen}..{start} are missing before an insert")
    return max(start, seen), end
