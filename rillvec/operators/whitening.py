"""Versioned linear transforms of vectors, fitted on their covariance.

``sqrt_cov`` maps by V sqrt(D) V', which stretches the directions that vary
most; ``zca`` is its inverse on centred data, the usual whitening.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument, NotFound
from ..plans.reduce import PARTIAL, collect_sums, partial
from .exact import matrix


@dataclass(frozen=True)
class Moments:
    """Row count, sum, and sum of outer products, in float64."""

    n: int
    total: np.ndarray
    outer: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.outer + other.outer)

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(1, self.n)

    @property
    def covariance(self) -> np.ndarray:
        """Population covariance."""
        return self.outer / max(1, self.n) - np.outer(self.mean, self.mean)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if len(batch):
            x = matrix(batch.column(0))
            x = np.hstack([np.ones((len(x), 1)), x])
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield partial(total)


def moments(df: DataFrame, column: str = "x") -> Moments:
    """Number, sum and sum of outer products: the products of rows with a leading 1, added on executors row by row of the matrix."""
    first = df.select(F.size(column)).first()
    if first is None:
        raise InvalidArgument("no rows to fit on")
    side = first[0] + 1
    total = collect_sums(df.select(column).mapInArrow(_moments, PARTIAL), side, side)
    return Moments(int(round(total[0, 0])), total[0, 1:], total[1:, 1:])


@dataclass(frozen=True)
class Transform:
    """x -> matrix (x - mean), and optionally to unit length."""

    version: int
    mean: np.ndarray
    matrix: np.ndarray
    cosine: bool = False

    @property
    def inverse(self) -> np.ndarray:
        try:
            return np.linalg.inv(self.matrix)
        except np.linalg.LinAlgError as e:
            raise FailedPrecondition("the transform is singular") from e

    def rows(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.matrix.T
        if self.cosine:
            size = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.divide(y, size, out=y.copy(), where=size > 0)
        return y

    def back(self, y: np.ndarray) -> np.ndarray:
        return y @ self.inverse.T + self.mean

    def apply(self, df: DataFrame, column: str = "x") -> DataFrame:
        return _map(df, column, self.rows)

    def unapply(self, df: DataFrame, column: str = "x") -> DataFrame:
        if self.cosine:
            raise FailedPrecondition("lengths are gone after normalisation")
        self.inverse  # noqa: B018 - fail here and not in a task
        return _map(df, column, self.back)


def _map(df: DataFrame, column: str, f) -> DataFrame:
    at = df.columns.index(column)
    fields = ", ".join(f"`{x.name}` {'array<double>' if x.name == column else x.dataType.simpleString()}" for x in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = f(matrix(batch.column(at)))
                new = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, fields)


def fit(m: Moments, version: int = 0, mode: str = "sqrt_cov", cosine: bool = False) -> Transform:
    """The transform of a covariance; negative eigenvalues of rounding count as 0."""
    if mode not in ("sqrt_cov", "zca"):
        raise InvalidArgument("mode must be sqrt_cov or zca")
    values, vectors = np.linalg.eigh(m.covariance)
    root = np.sqrt(np.clip(values, 0, None))
    if mode == "zca":
        if root.min() <= 1e-12 * max(1e-300, root.max()):
            raise FailedPrecondition("the covariance is singular")
        root = 1 / root
    return Transform(version, m.mean, (vectors * root) @ vectors.T, cosine)


def bridge(source: Transform, target: Transform) -> np.ndarray:
    """Takes centred vectors of one version to another."""
    return target.matrix @ source.inverse


def retarget(df: DataFrame, source: Transform, target: Transform, column: str = "x") -> DataFrame:
    """Rows in the space of ``source`` to that of ``target``."""
    return target.apply(source.unapply(df, column), column)


@dataclass
class Whitening:
    """All versions that are alive, and statistics that grow towards the next."""

    mode: str = "sqrt_cov"
    cosine: bool = False
    versions: dict[int, Transform] = field(default_factory=dict)
    pending: Moments | None = None

    def fit(self, df: DataFrame, column: str = "x") -> int:
        return self._add(moments(df, column))

    def update(self, df: DataFrame, column: str = "x") -> None:
        """Add a batch to the statistics of the next version."""
        m = moments(df, column)
        self.pending = m if self.pending is None else self.pending + m

    def finalize(self) -> int:
        if self.pending is None:
            raise FailedPrecondition("no statistics since the last version")
        version, self.pending = self._add(self.pending), None
        return version

    def refit(self, transformed: DataFrame, version: int, column: str = "x") -> int:
        """A new version from rows that are in the space of an old one."""
        return self._add(moments(self.get(version).unapply(transformed, column), column))

    def get(self, version: int) -> Transform:
        if version not in self.versions:
            raise NotFound(f"no transform of version {version}")
        return self.versions[version]

    def _add(self, m: Moments) -> int:
        version = max(self.versions, default=-1) + 1
        self.versions[version] = fit(m, version, self.mode, self.cosine)
        return version

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v, t.mean.tolist(), t.matrix.tolist(), t.cosine) for v, t in self.versions.items()], "whiten_version int, mean array<double>, t array<array<double>>, cosine boolean")

    @classmethod
    def from_table(cls, df: DataFrame, mode: str = "sqrt_cov") -> Whitening:
        rows = df.collect()
        return cls(mode, any(r["cosine"] for r in rows), {r["whiten_version"]: Transform(r["whiten_version"], np.array(r["mean"]), np.array(r["t"]), r["cosine"]) for r in rows})
