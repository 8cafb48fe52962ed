"""Intermediate tables that survive the loss of an executor.

``durable(df)`` writes a DataFrame as Parquet below the folder that the
session names in ``spark.checkpoint.dir`` and reads it back: lineage is cut,
column pruning works on the copy, and the planner knows its size.  Only where
no folder is named and the master is local (tests, a laptop) a temporary one is
made and removed at exit; a cluster without a shared folder is refused.  ``release`` deletes the tables of a session once results are written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FailedPrecondition

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    set_in_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_in_code.isDefined():
        return set_in_code.get()
    if not spark.sparkContext.master.startswith("local"):
        raise FailedPrecondition("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rillvec-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def durable(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder now and return a scan of the copy.

    With ``by`` the copy has a folder for each value of that column, so a filter
    on it reads only their files; rows are brought together first, a value with
    many rows in several files.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if by:
        df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> int:
    """Delete all tables that ``durable`` wrote in this session; results that still read them must be written first."""
    jvm, paths = spark.sparkContext._jvm, _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
