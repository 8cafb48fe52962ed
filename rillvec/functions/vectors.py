"""Vector expressions on array columns, for DataFrames and for SQL.

All arithmetic is in double precision and folds left in dimension order, so a
result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(x: str | Column) -> Column:
    return _col(x).cast("array<double>")


def total(values: Column) -> Column:
    """Sum of an array, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def norm2(x: str | Column) -> Column:
    """Squared norm."""
    return F.aggregate(as_double(x), F.lit(0.0), lambda a, v: a + v * v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2sq(a: str | Column, b: str | Column) -> Column:
    """Squared distance in the direct form; never negative."""
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2sq_by_norms(norm_a: Column, norm_b: Column, product: Column, clamp: bool = True) -> Column:
    """Squared distance from two squared norms and a dot product; rounding can make it negative unless clamped."""
    value = norm_a + norm_b - 2 * product
    return F.greatest(F.lit(0.0), value) if clamp else value


def normalize(x: str | Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = F.sqrt(norm2(x))
    return F.when(size > 0, F.transform(as_double(x), lambda v: v / size)).otherwise(as_double(x))


def subvector(x: str | Column, m: int | Column, width: int) -> Column:
    """Dimensions m * width up to (m + 1) * width."""
    return F.slice(_col(x), (m if isinstance(m, Column) else F.lit(m)) * width + 1, width)


def residual(x: str | Column, centre: str | Column) -> Column:
    return F.zip_with(as_double(x), as_double(centre), lambda a, b: a - b)


def affine(matrix: Column, x: str | Column, mean: str | Column) -> Column:
    """matrix (rows of doubles) times (x - mean)."""
    centred = residual(x, mean)
    return F.transform(matrix, lambda row: total(F.zip_with(row, centred, lambda a, b: a * b)))


def pq_decode(codes: str | Column, codebook: str | Column) -> Column:
    """The codewords of a code, end to end; the codebook is array<array<array<double>>> by subspace and word."""
    return F.flatten(F.transform(_col(codes), lambda k, m: F.get(F.get(_col(codebook), m), k.cast("int"))))


def adc(table: str | Column, codes: str | Column) -> Column:
    """Sum over subspaces of the looked-up distances."""
    return total(F.transform(_col(codes), lambda k, m: F.get(F.get(_col(table), m), k.cast("int"))))


# Bodies of the SQL functions, by name: parameters, result, expression.
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "vec_norm2": ("x ARRAY<DOUBLE>", "DOUBLE", "aggregate(x, 0D, (a, v) -> a + v * v)"),
    "vec_dot": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)"),
    "vec_l2sq": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)"),
    "vec_sub": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(x, y, (a, b) -> a - b)"),
    "vec_slice": ("x ARRAY<DOUBLE>, m INT, width INT", "ARRAY<DOUBLE>", "slice(x, m * width + 1, width)"),
    "vec_normalize": ("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(x, v -> CASE WHEN aggregate(x, 0D, (a, w) -> a + w * w) > 0 THEN v / sqrt(aggregate(x, 0D, (a, w) -> a + w * w)) ELSE v END)"),
    "pq_decode": ("codes ARRAY<SMALLINT>, book ARRAY<ARRAY<ARRAY<DOUBLE>>>", "ARRAY<DOUBLE>", "flatten(transform(codes, (k, m) -> get(get(book, m), k)))"),
    "adc": ("lut ARRAY<ARRAY<DOUBLE>>, codes ARRAY<SMALLINT>", "DOUBLE", "aggregate(transform(codes, (k, m) -> get(get(lut, m), k)), 0D, (s, v) -> s + v)"),
}


def register(spark: SparkSession) -> None:
    """Make the SQL functions known to the session; they are expressions, not Python."""
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
