"""Vector files: rows of an int32 dimension and as many float32 values, little-endian.

Rows of a file have one length, so a file is cut at row borders by any number
of tasks and nothing is read to find them.  Files are opened through Hadoop,
so any store that Spark can read will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataCorruption, InvalidArgument, NotFound


@dataclass(frozen=True)
class FileInfo:
    rows: int
    dim: int
    path: str


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def resolve(spark: SparkSession, path: str, suffix: str) -> str:
    """``path`` if it is a file, else the first file by name in that folder that ends in ``suffix``."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise NotFound(path)
    if not fs.getFileStatus(p).isDirectory():
        return path
    found = sorted(str(s.getPath()) for s in fs.listStatus(p) if str(s.getPath()).endswith(suffix))
    if not found:
        raise NotFound(f"no *{suffix} in {path}")
    return found[0]


def inspect(spark: SparkSession, path: str) -> FileInfo:
    """Rows and dimension from the header and the file's size."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        raise NotFound(path)
    size = fs.getFileStatus(p).getLen()
    if size < 4:
        raise DataCorruption(f"{path} is empty")
    stream = fs.open(p)
    try:
        head = bytes(stream.read() & 0xFF for _ in range(4))
    finally:
        stream.close()
    dim = struct.unpack("<i", head)[0]
    if dim <= 0:
        raise DataCorruption(f"dimension {dim} in {path}")
    width = 4 + 4 * dim
    if size % width:
        raise DataCorruption(f"{path}: {size} bytes are no multiple of {width}")
    return FileInfo(size // width, dim, path)


def read(spark: SparkSession, path: str, begin: int = 0, count: int | None = None, id_name: str = "doc_id", x_name: str = "x") -> DataFrame:
    """id (the row number) and vector of rows begin .. begin + count; all rows by default.

    A row that names another dimension makes the task fail.
    """
    info = inspect(spark, path)
    count = info.rows - begin if count is None else count
    if begin < 0 or count < 0 or begin + count > info.rows:
        raise InvalidArgument(f"rows {begin}..{begin + count} of {info.rows}")
    dim = info.dim

    def parse(records: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, list[float]]]:
        for raw, row in records:
            if struct.unpack_from("<i", raw)[0] != dim:
                raise DataCorruption(f"row {row} of {path} has another dimension")
            if begin <= row < begin + count:
                yield row, np.frombuffer(raw, "<f4", dim, 4).tolist()

    # The one place where an RDD is used: fixed-length records have no DataFrame reader.
    records = spark.sparkContext.binaryRecords(path, 4 + 4 * dim).zipWithIndex()
    return spark.createDataFrame(records.mapPartitions(parse), f"{id_name} long, {x_name} array<float>")


def write(df: DataFrame, path: str, id_name: str = "doc_id", x_name: str = "x") -> FileInfo:
    """One file, in the order of ids, written row by row by the driver: an export of bounded size."""
    rows, dim = 0, 0
    with open(path, "wb") as f:
        for r in df.select(id_name, x_name).orderBy(id_name).toLocalIterator():
            x = np.asarray(r[1], dtype="<f4")
            if rows and len(x) != dim:
                raise InvalidArgument("vectors have different dimensions")
            dim = len(x)
            f.write(struct.pack("<i", dim) + x.tobytes())
            rows += 1
    return FileInfo(rows, dim, path)


def synthetic(spark: SparkSession, rows: int, dim: int, seed: int = 42, id_name: str = "doc_id", x_name: str = "x") -> DataFrame:
    """Rows of uniform values in [-1, 1) that depend on the seed, the row and the dimension alone."""
    value = lambda j: ((F.xxhash64("id", j, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 52))) - 1.0).cast("float")
    return spark.range(rows).select(F.col("id").alias(id_name), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias(x_name))
